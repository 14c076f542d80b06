"""The pipeline's stages, each against plain Python on what the stage before kept."""

import base64

import corpus_pipeline as p
import public_tokenizers
import tiktoken
from test_llm import contamination_brute, line_brute, near_brute


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {"start": docs.collect()}
    frame = docs
    for name, stage in p.STAGES:
        stage(spark, frame, sf_dir).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = frame.collect()
        if name != "encode":
            assert frame.columns == list(p.COLUMNS) and all(r.n_chars == len(r.text) for r in kept[name])
    texts = lambda name: [(r.doc_id, r.text) for r in kept[name]]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stayed = {i for i, _ in texts("quality")}
    assert all((i in stayed) == bool(y) for i, y in quality.items())
    lines = line_brute(texts("quality"))
    assert dict(texts("lines")) == {i: v[2] for i, v in lines.items()}
    near = near_brute(texts("lines"))
    assert {i for i, _ in texts("near")} == {i for i, v in near.items() if v[1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = contamination_brute(texts("near"), items)
    assert {i for i, _ in texts("benchmark")} == {i for i, v in bad.items() if not v[3]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(texts("benchmark"))
    assert {(r.doc_id, tuple(r.ids), r.decoded_text) for r in kept["encode"]} == {(i, tuple(own.encode_ordinary(t)), t) for i, t in text.items()}
    whole = p.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "n_tokens").collect())) == sorted((r.doc_id, r.n_tokens) for r in kept["encode"])


def test_stages_on_hostile_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a column more, and an empty table."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    good = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1"), "doc_id").first().text
    rows = [(None, good), (None, good), (None, item), (None, None), (5, None), (6, ""), (7, good), (7, good), (7, item), (8, good)]
    odd = spark.createDataFrame([(i, t, "en", "s", 1, "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ident string")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == list(p.COLUMNS) and stage(spark, odd.limit(0), sf_dir).count() == 0
        got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in out.collect())
        if name == "lines":
            assert len(got) == 10 and got.count((-1, good)) == 2
        if name == "near":
            assert got == sorted((-1 if i is None else i, t or "") for i, t in rows if i != 8)
        if name == "benchmark":
            assert got == sorted((-1 if i is None else i, t or "") for i, t in rows if t != item)
    encoded = p.encode(spark, odd, sf_dir).collect()
    assert len(encoded) == 10 and sorted(r.decoded_text for r in encoded) == sorted(t or "" for _, t in rows)
