"""Embeddings, conversations, archives, components, the pipeline."""

import hashlib
import json
import random

import duckdb
import numpy as np
import pytest

from loomtext.llm import chat, embed, queries, warc
from loomtext.llm.components import components

SMALL = "/root/testdata/sf0.001"


def _components(n, pairs):
    up = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    want = {i: x for i, x in enumerate(_components(600, pairs))}
    rows = [*pairs, *pairs[:20], (7, 7), (None, 3)]
    got = {x.node: x.label for x in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and {a for p in pairs for a in p if p[0] != p[1]} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket_rows", [2048, 16])
def test_embeddings(spark, bucket_rows):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 16)).astype(np.float32)
    near = np.concatenate([base, base[:20] + 0.15 * r.standard_normal((20, 16)).astype(np.float32), *[base[:1] + 0.05 * r.standard_normal((60, 16)).astype(np.float32)], base[5:8]])
    rows = [(i, v.tolist(), 0, "z") for i, v in enumerate(near)]
    odd = [(200, None, 0, "z"), (201, [0.0] * 16, 0, "z"), (202, [float("nan")] * 16, 0, "z"), (203, [None] * 16, 0, "z"), (None, near[0].tolist(), 0, "z"), (204, [], 0, "z"), (205, [1.0, 2.0], 0, "z"), (206, [2.0, 4.0], 0, "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, signs string")
    got = {x.vec_id: x for x in embed.near_duplicates(df, recall=0.9999, bucket_rows=bucket_rows).collect()}
    u = near.astype(float)
    c = (u @ u.T) / np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(u, axis=1)) >= 0.9
    np.fill_diagonal(c, False)
    up = _components(len(near), list(zip(*np.nonzero(c), strict=True)))
    assert [got[i].n_links for i in range(len(near))] == c.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(near))] == up and all(got[i].kept == (up[i] == i) for i in range(len(near)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (200, 201, 202, 203, 204)) and got[None].n_links == 0
    assert got[205].n_links == 1 and got[206].component_id == 205
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a < b \\ </turn> <turn x>"), (1, 1, "assistant", "\\\\<>"), (2, 1, "assistant", None), (2, None, None, "first"), (None, 0, "assistant", "é😀\n"), (None, 1, "a>\n<\\", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, head string")
    got = {x.conv_id: x for x in chat.read_back(chat.format_turns(chat.turns_of_table(df))).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: -1 if x[1] is None else x[1])
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(chat.turns_of_table(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.turns_of_table(df.drop("role"))


def test_chat_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a", "score": {"x": 1}}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "{"), (91, None), (92, '{"other": 1}')], "conv_id long, raw string")
    got = {}
    for x in chat.turns_of_json(df, "conv_id", "raw").orderBy("conv_id", "turn").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert all(got[i] == turns for i in range(len(records))) and all(got[i] == [(None, None)] for i in (90, 91, 92))
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [(x.role, x.text) for x in chat.turns_of_table(nested).orderBy("turn").collect()] == turns


def test_chat_extra_columns(spark):
    """Further columns, whatever mapping knows their names, leave the layout as it is."""
    for name in ("prompt", "system", "input", "output", "response", "completion", "instruction", "score"):
        df = spark.createDataFrame([(1, 0, "user", "q", "z"), (1, 1, "assistant", "a", "z")], f"conv_id long, turn long, role string, text string, {name} string")
        assert [(x.role, x.text) for x in chat.turns_of_table(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    assert chat.turns_of_record({"prompt": "q", "response": "a", "output": "o", "role": "r"})[1] == [("user", "q"), ("assistant", "a")]


def test_chat_odd_records(spark):
    deep = "[" * 100_000 + "]" * 100_000
    good = {"role": "user", "content": "q"}
    records = [
        (json.dumps({"messages": [good, None]}), [("user", "q")]), (json.dumps({"messages": [good, "loose", 3]}), [("user", "q"), ("", "loose"), ("", "3")]),
        ('{"messages": ' + deep + "}", None), ('{"messages": [{"role": "user", "content": "\\ud800x"}]}', [("user", "\ufffdx")]), (json.dumps({"messages": {"role": "user", "content": "q"}}), None),
        (json.dumps([good]), None), (json.dumps({"messages": [{"role": None, "content": {"a": [1]}}]}), None), ('"text"', None), (json.dumps({"messages": []}), None),
        (json.dumps({"prompt": None, "response": 5}), [("user", ""), ("assistant", "5")]),
    ]
    got = {}
    for x in chat.turns_of_json(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "conv_id long, raw string"), "conv_id", "raw").orderBy("conv_id", "turn").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert [got[i] for i in range(len(records))] == [w or [(None, None)] for _, w in records]


def test_warc_audit(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 50)}</p>", "z", "z") for i in range(700)] + [(None, None, None, "z", "z"), (5, "http://x/5", "twice", "z", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, record string")
    bad = {3, 77, 500}
    other = spark.createDataFrame([(i, u, h.replace("<p>", "<q>") if i in bad and h != "twice" else h, a, b) for i, u, h, a, b in rows], pages.schema)
    got = warc.audit_pages(pages, other, records_a_file=40).collect()
    assert len(got) == 702 and {x.page_id for x in got if x.corrupt} == bad
    assert all((x.root == x.replica_root) or x.file in {y.file for y in got if y.corrupt} for x in got)
    assert not any(x.corrupt for x in warc.audit_pages(pages, pages, records_a_file=40).collect())
    assert warc.audit_pages(pages.limit(0), pages.limit(0)).count() == 0
    short = warc.audit_pages(pages, pages.where("page_id <> 9 or page_id is null"), records_a_file=40).collect()
    assert {x.file for x in short if x.corrupt} == {x.file for x in short if x.page_id == 9}


def test_warc_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a", "x\r\n\r\ny"), (2, "http://b", "é"), (3, None, None)], "page_id long, url string, html string")
    texts = [r[0] for r in pages.select(warc.record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes("".join(texts).encode())
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record").collect()
    assert [bytes(x.body).decode() for x in got] == ["x\r\n\r\ny", "é", ""]
    assert [x.length for x in got] == [len(t.encode()) for t in texts]
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")


def test_warc_goes_on_after_faults(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, f"http://{i}", f"body {i}") for i in range(5)], "page_id long, url string, html string")
    texts = [r[0] for r in pages.orderBy("page_id").select(warc.record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    texts[1], texts[3] = texts[1].replace("Content-Length: 6", "Content-Length: 7"), "rubbish\r\n\r\n"
    (tmp_path / "a.warc").write_bytes("".join(texts).encode())
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record").collect()
    assert [x.body and bytes(x.body).decode() for x in got] == ["body 0", None, "body 2", None, "body 4"]
    assert [x.error is None for x in got] == [True, False, True, False, True] and sum(x.length for x in got) == len("".join(texts))


def test_archive_files_change_at_powers_of_two_only():
    assert [warc.files_for(n, 10) for n in (0, 1, 10, 11, 20, 21, 40, 41)] == [1, 1, 1, 2, 2, 4, 4, 8]


def test_embeddings_in_doubles(spark):
    """Two vectors whose cosine falls below the bound only in digits that single precision doesn't have."""
    a = [1.0, 0.0]
    c = 0.9 - 1e-12
    b = [c, float(np.sqrt(1 - c * c))]
    df = spark.createDataFrame([(0, a), (1, b), (2, [0.9 + 1e-12, float(np.sqrt(1 - (0.9 + 1e-12) ** 2))])], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in embed.near_duplicates(df, recall=0.9999).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.execute(sql).df()
        got = queries.queries()[name](spark, SMALL).toPandas()
        key = want.columns[0]
        assert sorted(got.columns) == sorted(want.columns)
        got, want = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
        assert got.equals(want.astype(got.dtypes.to_dict()))


def test_pipeline(spark):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{SMALL}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] > 0
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SMALL).count() == 0


def _small(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = [" ".join(word() for _ in range(r.randint(5, 120))) for _ in range(60)]
    texts += [t + " end" for t in texts[:10]] + ["write to jo@example.com or +1 389 555 0100 now"]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on a small table against a plain version of what it decides."""
    import corpus_pipeline
    from loomtext.llm import mixing, packing, pii, quality

    stages, docs = dict(corpus_pipeline.STAGES), _small(spark)
    rows = {x.doc_id: x for x in docs.collect()}

    model = quality.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    found = {x.doc_id: x.predicted for x in quality.scored(spark.read.parquet(f"{SMALL}/documents.parquet"), model).collect()}
    kept = stages["quality classifier"](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, p in found.items() if p == 1)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(x.text) for i, x in rows.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    up = _components(len(rows), pairs)
    assert sorted(x.doc_id for x in stages["SimHash near-dedup"](spark, docs, SMALL).collect()) == sorted(set(up))

    clean = {x.doc_id: x.text for x in stages["PII"](spark, docs, SMALL).collect()}
    assert clean == {i: pii.sanitised(x.text, [{"kind": k, "start": a, "end": b} for k, a, b in pii.base_spans(x.text)], []) for i, x in rows.items()}

    mixed = stages["mixing sources"](spark, docs, SMALL).collect()
    words = {}
    for x in mixed:
        words[x.doc_id] = words.get(x.doc_id, 0) + len(x.text.split())
    assert words == {x.doc_id: x.taken for x in mixing.mix(docs).collect() if x.taken}

    packed = stages["best-fit packing"](spark, docs, SMALL).collect()
    ids = packing._Encoder(None)
    want = {i: len(ids([x.text.encode()])[0]) // 4 + 1 for i, x in rows.items()}
    assert {x.doc_id: x.length for x in packed} == want
    assert len({x.sequence_id for x in packed}) == -(-sum(want.values()) // 2048)
