"""The pipeline's stages one after the other, and that each decision takes effect."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from skeingraph.llm import byte_bpe, chosen_path, language_id, line_crf, queries

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = set(rows)
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, stage = stage, f(spark, stage, SMALL)
        assert stage.columns == docs.columns
        now = {r["doc_id"] for r in stage.collect()}
        assert now <= left
        if name == "language":
            one = language_id.judge(language_id.fit(before))
            assert now == {i for i in left if one(rows[i])[0] != "und"}
        elif name == "quality":
            model = line_crf.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            assert now == {i for i in left if not line_crf.base_counts(rows[i])[-1] and line_crf.content_share(rows[i], model) >= 0.5}
        elif name == "near_duplicates":
            assert now == {r["doc_id"] for r in chosen_path.join(before).collect() if r["doc_id"] == r["class_id"]}
        else:
            assert now == left - {r["doc_id"] for r in queries.op1_decontaminate(spark, SMALL).collect()}
        left = now
    ranks = byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS_FILE))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert out == {i: hashlib.sha256(",".join(map(str, own.encode_ordinary(rows[i]))).encode()).hexdigest() for i in left} and len(left) > 100


def test_language_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = {r["doc_id"] for r in docs.collect()}
    texts = ["Это длинный текст на языке, которого никто не учил, и он идёт дальше и дальше.", "xzqk" * 200, "qqqq " * 100, "1234"]
    known.add(100_000)
    odd = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(texts)] + [(100_000, "Avec.")], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(odd, allowMissingColumns=True), SMALL).collect()}
    assert kept == known


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rng, vocabulary = random.Random(3), "this is the text of a town and its people who were there for some time in other places with what they had made by hand from wood or stone when it was cold outside".split()
    good = "\n".join(" ".join(rng.choices(vocabulary, k=14)).capitalize() + "." for _ in range(8))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, good, "en"), (4, good, "en"), (5, good, "en"), (None, good + " And one more line of it is here.", "en"), (6, "1234 5678", "en"), (7, "word " * 50_000, "en"), (8, good.upper()[:400] + " what is the answer of all", "en")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, th bigint, score double, again_id bigint"
    tables = {
        "documents": spark.createDataFrame([(i, t, lang, None, len(t or ""), "x", 1, 0.0, 4) for i, t, lang in rows], schema),
        "labels": spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "what is the answer of all"), (None, None), (2, "")], "item_id bigint, text string"),
    }
    for empty in (False, True):
        at = tmp_path / str(empty)
        for name, rows_of in tables.items():
            (rows_of.limit(0) if empty else rows_of).write.parquet(f"{at}/{name}.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, str(at))
            assert kept.columns == docs.columns
            left = sorted((r["doc_id"] for r in kept.collect()), key=str)
            if empty:
                assert left == []
            elif name in ("language", "quality"):
                assert not {1, 2, 3, 6} & set(left) and {4, 5} <= set(left) and left.count(4) == 2
            elif name == "near_duplicates":
                assert {1, 2, 3} <= set(left) and len({4, 5, None} & set(left)) == 1 and left.count(4) <= 1
            else:
                assert 8 not in left and {1, 2, 3, 4} <= set(left) and left.count(4) == 2
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert len(out) == len(set(out)) and bool(out) != empty
