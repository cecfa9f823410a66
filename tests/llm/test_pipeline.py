import corpus_pipeline
from keysieve.llm import bpe, quality
from keysieve.llm.queries import tokenizer_path
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_lines import key
from tests.llm.test_neardup import brute as brute_groups


def without_repeats(rows):
    owner = {}
    for i, text in sorted(rows):
        for line in text.split("\n"):
            owner.setdefault(key(line), i)
    return [(i, "\n".join([x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i])) for i, t in rows]


def test_against_brute_force(spark, sf_dir):
    from keysieve.llm.neardup import Near

    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    good = {r.doc_id for r in quality.classify(tables["documents"], tables["labels"]).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text or "") for r in tables["documents"].collect() if r.doc_id in good]
    rows = without_repeats(rows)
    first = {i: c for i, _, c in brute_groups(rows, Near(words=5))}
    rows = [(i, t) for i, t in rows if first[str(i)] in (None, i)]
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    hit = {i for i, _, n, *_ in brute_hits(rows, items) if n}
    rows = [(i, t) for i, t in rows if str(i) not in hit]
    encoder = bpe.ChunkEncoder(tokenizer_path())
    want = sorted((i, len(ids) // 4, ids) for (i, _), (ids, _) in zip(rows, encoder.encode([t for _, t in rows]), strict=True))
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and 0 < len(hit) and len(got) > 100


def test_stages_keep_columns_and_odd_rows(spark, docs, sf_dir):
    odd = docs([(1, None), (2, ""), (2, ""), (None, "a line of words here"), (3, "a line of words here"), (4, "word " * 30000)], extra=True)
    for frame in (odd, odd.where("doc_id < 0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            if name != "tokens":
                assert out.columns == frame.columns and out.dtypes == frame.dtypes
            out.collect()
