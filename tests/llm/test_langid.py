import pytest

from quillspark.llm import langid

SF = "/root/testdata/sf0.001"


def test_a_small_language_keeps_its_words(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    large, small = [f"en{word(i)}" for i in range(200)], [f"xx{word(i)}" for i in range(80)]
    docs = spark.createDataFrame([("en", " ".join(large))] * 10 + [("xx", " ".join(small))], "lang string, text string")
    all_words = langid.train(docs, max_words=200).words
    assert set(large) | set(small) <= set(all_words)
    few = set(langid.train(docs, max_words=100).words)
    assert 20 <= len(few & set(small)) <= 80 and len(few & set(large)) >= 50 and len(few) <= 200


def test_bounds_of_the_held_model_change_no_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text", "source")
    odd = [(-1, "en", None, "a"), (-2, None, "", "a"), (-3, "fr", "123 ...", None), (-4, "xx", "zzqx " * 3, "a"), (None, None, "wörter und ŧħŋ Ελλάδα", "b"), (-6, None, "a" * 5000 + " le la les", "b"), (-6, None, "a" * 5000 + " le la les", "b")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    fold = docs.filter("doc_id % 3 > 0")
    whole, bounded = langid.train(fold, max_words=10**6, max_grams=10**6), langid.train(fold, max_words=40, max_grams=60)
    assert whole.tables is None and bounded.tables is not None and len(bounded.words) < 100 < len(whole.words)
    get = lambda model: sorted(map(tuple, langid.identify(docs, model).collect()), key=repr)
    want, got = get(whole), get(bounded)
    assert len(got) == len(want) == docs.count()
    for a, b in zip(want, got, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-4)
    assert langid.identify(docs.limit(0), bounded).count() == 0
    clash = docs.withColumnsRenamed({"source": "_row", "lang": "_base"})
    assert langid.identify(clash, bounded).columns == ["doc_id", "_base", "text", "_row", "lang_pred", "score"]
    assert langid.identify(clash, bounded).count() == docs.count()
