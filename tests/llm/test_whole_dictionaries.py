"""The classifier's dictionaries hold whole texts."""

from lodestack.llm import compression_classifier

from .test_llm_operators import frame, words


def test_what_stands_late_in_a_text_enters_the_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(compression_classifier, "DICTIONARY_BYTES", 100_000)
    texts = [" ".join(words(i, 4000)) + (f" good end {i}" if i % 2 else f" bad end {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = compression_classifier.fit(frame(spark, texts), labels)
    for y, name in ((0, "bad"), (1, "good")):
        whole = [t.encode() for i, t in enumerate(texts) if i % 2 == y]
        content, n = model[name], 0
        while content:
            found = [t for t in whole if content.startswith(t)]
            assert len(found) == 1
            content, n = content[len(found[0]) :], n + 1
        assert len(model[name]) >= 100_000 > len(model[name]) - max(map(len, whole)) and n > 3
