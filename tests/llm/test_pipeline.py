"""The pipeline against its stages done by brute force, and the rules of its entry point."""

import random

import corpus_pipeline
from indexloom.llm import bpe, chunks, mixing, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing", "byte-level BPE"]


def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns[:5] == columns
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


def test_rows_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r.doc_id for r in docs.collect() if quality.judge([r.text], list(quality.RULES))["kept"][0]]
    rows = docs.where(docs.doc_id.isin(kept))
    cut = {(r.doc_id, r.nth) for r in chunks.repeated_chunks(rows).collect()}
    parts = {r.doc_id: r.c for r in rows.select("doc_id", chunks.chunks(rows.text).alias("c")).collect()}
    texts = {i: "\n".join(c for k, c in enumerate(p) if (i, k) not in cut) for i, p in parts.items()}
    texts = {i: t for i, t in texts.items() if t.split()}
    order = sorted(texts)
    bags = {}
    for i in order:
        w = texts[i].split()
        bags[i] = {}
        for k in range(max(len(w) - 4, 1)):
            s = tuple(w[k : k + 5])
            bags[i][s] = bags[i].get(s, 0) + 1
    parent = {i: i for i in order}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(order):
        for j in order[:n]:
            a, b = bags[i], bags[j]
            least = sum(min(v, b.get(s, 0)) for s, v in a.items())
            if 5 * least >= 4 * (sum(a.values()) + sum(b.values()) - least):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    one = {i for i in order if root(i) == i}
    facts = {r.doc_id: r for r in docs.collect()}
    left = spark.createDataFrame([(i, texts[i], facts[i].lang, facts[i].source, facts[i].n_chars) for i in sorted(one)], docs.schema)
    sampled = {r.doc_id for r in mixing.mixture(left).collect() if r.sampled}
    vocab = bpe.vocabulary(bpe.read_vocabulary())
    want = {i: next(bpe.encode([texts[i]], vocab))[0] for i in sampled}
    assert {r.doc_id: bytes(r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert neardup.near_duplicates(left).where("class_id <> doc_id").isEmpty()


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    rnd = random.Random(16)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    clean, long, lines = words(60), words(60_000), "\n".join(words(12) for _ in range(30))
    rows = [(0, None, None, None, None), (1, "", "en", "src0", 0), (2, clean, "en", "src0", 1), (2, clean, "en", "src0", 1), (3, clean, None, None, None), (None, clean, "de", "src1", 1), (None, None, None, None, None), (4, long, "en", "src0", 1), (5, lines, "fr", "src0", 1), (6, lines, "fr", "src2", 1)]
    extra = "node string, own string, row string, bucket string, token_ids string"
    docs = spark.createDataFrame([(*r, *["extra"] * 5) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == [2, 4, 5]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {2, 4, 5} and all(r.node == r.own == r.row == r.bucket == r.token_ids == "extra" and r.n_tokens * 4 == len(r._token_ids) for r in got)
