import random

from lexiloom.llm import quality


def test_common_words_of_any_length_and_script_are_counted(spark, monkeypatch):
    r = random.Random(5)
    common = ["когда", "потому", "который", "स्वतंत्रता", "development", "a"]
    rare = ["".join(r.choice("бвгдежз") for _ in range(9)) for _ in range(3000)]
    rows = [(k, " ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(200)), "xx") for k in range(40)]
    for most in (quality.MOST, 100):  # in one part and in many
        monkeypatch.setattr(quality, "MOST", most)
        ref = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["xx"]
        counts = {w: sum(t.split().count(w) for _, t, _ in rows) for w in common}
        assert {w: int(ref["counts"][ref["words"].index(w.encode())]) for w in common} == counts
        assert len(ref["words"]) == quality.TOP and ref["counts"].sum() == 40 * 200


def test_texts_without_the_common_words_of_a_script_are_rejected(spark):
    r = random.Random(6)
    common, rare = ["потому", "который", "сегодня"], ["".join(r.choice("бвгдежзик") for _ in range(8)) for _ in range(4000)]
    text = lambda share: " ".join(r.choice(common if r.random() < share else rare) for _ in range(300))
    rows = [(k, text(0.5 if k else 0), "ru") for k in range(40)]
    kept = {x["doc_id"]: x["kept"] for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[0] and all(kept[k] for k in range(1, 40))
