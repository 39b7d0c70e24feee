"""The corpus pipeline stage by stage, and the registered queries' shapes."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from topoframe.llm import packing, queries, secrets, stages, toxicity, word_ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "secrets", "packing"]
    calm = stages.drop_toxic(spark, given, SF)
    scores = {x.doc_id: x.predicted for x in toxicity.classify(given, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {x.doc_id for x in calm.collect()} == {i for i, p in scores.items() if not p} and calm.columns == given.columns
    single = stages.drop_near_copies(spark, calm, SF)
    assert single.columns == given.columns and 0 < single.count() < calm.count()
    texts = [x.text.lower().split() for x in single.collect()]
    exact = [tuple(t) for t in texts if t]
    assert len(exact) == len(set(exact))
    clean = stages.redact_secrets(spark, single, SF)
    assert clean.columns == given.columns and clean.count() == single.count()
    assert clean.filter(F.col("text").rlike(r'token = "[0-9a-f]{40}"')).count() == 0 and clean.filter(F.length("text") != F.col("n_chars")).count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert {x.doc_id for x in whole.select("doc_id").distinct().collect()} == {x.doc_id for x in single.collect()}
    assert whole.columns == packing.pack(given, public_tokenizers.path("byte_bpe_50k.json")).columns


def test_stages_on_odd_rows(spark):
    """One of the copies with the id 4 stays; the copies without an id and with the id 9 go; empty texts stay."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13), (9, "A b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("score", "_score", "_text", "a", "b", "row", "count", "kept")})
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
    assert sorted((x.doc_id or 0) for x in docs.collect()) == [1, 2, 4]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def kept_rows(rows):
    """Brute force of the near-copy stage over (id, text): indices of the rows that stay."""
    sets, texts = [shingles(t) for _, t in rows], {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else ("empty", i), []).append(i)
    own = lambda i: rows[i][0] is not None and len(texts[rows[i][0]]) == 1
    return groups, own


def test_near_copies_by_brute_force(spark):
    r = random.Random(22)
    word = lambda: r.choice("abcdef") + r.choice("ghijk") + r.choice("lmnop")
    base = [[word() for _ in range(r.choice([2, 6, 40, 90]))] for _ in range(10)]
    rows = []
    for b in base:
        for _ in range(r.randint(1, 6)):
            w = list(b)
            if r.random() < 0.7:
                w[r.randrange(len(w))] = word()
            rows.append((r.choice([None, *range(30)]), " ".join(w)))
    rows += [(3, None), (3, None), (None, ""), (31, "  "), (31, "")] + rows[:5]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = [(x.doc_id, x.text) for x in stages.drop_near_copies(spark, docs, SF).collect()]
    groups, own = kept_rows(rows)
    left = list(got)
    for key, members in groups.items():
        mine = [rows[i] for i in members]
        if not isinstance(key, int):
            continue  # empty texts, below
        if own_ids := sorted(i for k in members if own(k) for i in [rows[k][0]]):
            want = [x for x in mine if x[0] == own_ids[0]][:1]
            assert sum(left.count(x) for x in set(mine)) == 1 and left.count(want[0]) == 1
        else:  # only rows without an id of their own: any one of them
            assert sum(left.count(x) for x in set(mine)) == 1
    assert sorted(t or "" for _, t in got if not (t or "").strip()) == sorted(t or "" for _, t in rows if not (t or "").strip())


def test_stages_by_brute_force(spark):
    """Each stage over a table of the driver's, against what the operators' brute-force tests call right."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {x.doc_id: x.text for x in given.collect()}
    groups, _ = kept_rows(sorted(texts.items()))
    ids = sorted(texts)
    want = {min(ids[k] for k in members) for members in groups.values()}
    single = stages.drop_near_copies(spark, given, SF)
    assert {x.doc_id for x in single.collect()} == want
    found = {}
    for x in secrets.scan(single).filter("is_secret").collect():
        found.setdefault(x.doc_id, []).append((x.start - 1, x.length, x.value))
    for x in stages.redact_secrets(spark, single, SF).collect():
        text, values = texts[x.doc_id], {v for _, _, v in found.get(x.doc_id, [])}
        for at, n, _ in sorted(found.get(x.doc_id, []), reverse=True):
            text = text[:at] + "[SECRET]" + text[at + n :]
        assert x.text == text and x.n_chars == len(text or "") and not any(v in text for v in values)
    total = 0
    library = word_ids.word_ids(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    packed = stages.pack(spark, given, SF).collect()
    own = {}
    for x in packed:
        own.setdefault(x.doc_id, []).append((x.start, x.length, x.ids_crc32))
    for i, t in texts.items():
        whole = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for start, n, crc in sorted(own[i]):
            assert start == at and zlib.crc32(np.array(whole[start : start + n], "<u4").tobytes()) == crc
            at += n
        assert at == len(whole)
        total += at
    assert len({x.sequence_id for x in packed}) <= -(-total // 1024) * 1.01 + 2


def test_sql_twin(spark):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        q = c.execute(sql)
        cols = [d[0] for d in q.description]
        want = sorted(map(repr, q.fetchall()))
        got = queries.QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(cols), name
        assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want, name
