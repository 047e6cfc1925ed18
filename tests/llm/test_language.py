import numpy as np
import pytest

from spectraloom.llm.language import Model, as_written, document_languages, fit, from_bytes, infer, passages, restored, segments

EN = "The river is near the garden and the people walk along the bridge when the lanterns are lit. "
FR = "La rivière est près du jardin et les gens marchent sur le pont quand les lanternes sont allumées. "
RU = "Река находится рядом с садом и люди ходят по мосту когда зажигаются фонари вечером. "
SAMPLES = [("en", EN + "There are many houses with windows in that street."), ("fr", FR + "Il y a beaucoup de maisons avec des fenêtres dans cette rue."), ("RU", RU + "На этой улице много домов с большими окнами.")]


@pytest.mark.parametrize("charset", ["latin-1", "cp1251", "koi8-r", "iso8859-2"])
def test_restored(charset):
    for text in (FR, RU):
        assert restored(text.encode().decode(charset, errors="replace")) == text
        assert restored(text) == text
    assert restored("") == "" and restored("plain") == "plain"


@pytest.mark.parametrize("own, read_as", [("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
def test_crossed_charsets(own, read_as):
    table = Model([(lang.lower(), text) for lang, text in SAMPLES]).table
    assert as_written((RU * 3).encode(own).decode(read_as), table) == RU * 3
    for text in (RU, FR, RU.upper(), "", "?", RU.encode().decode("latin-1")):
        assert as_written(text, table) == restored(text)


@pytest.mark.parametrize("charset", ["utf-8", "cp1251", "koi8-r"])
def test_lost_bytes(spark, charset):
    model = Model([(lang.lower(), text) for lang, text in SAMPLES])
    page = f"<html><head><title>x</title></head><body><p>{RU}</p><ul><li>Меню</li></ul><p>{RU * 2}</p></body></html>".encode(charset)
    lines = [line.strip() for line in from_bytes(page, model.table).split("\n") if line.strip()]
    assert lines == [RU.strip(), "Меню", (RU * 2).strip()]
    rows = [(1, "\ufffd" * 200, page), (2, EN * 3, page), (3, "\ufffd" * 200, None), (4, "\ufffd" * 9, b"")]
    found = segments(spark.createDataFrame(rows, "doc_id long, text string, raw binary"), model, "doc_id", "text", "raw").filter("id in (1, 2)")
    assert {(r.id, r.lang) for r in found.collect()} == {(1, "ru"), (2, "en")}


def test_passages_leave_the_furniture_out():
    page = f"A title here\nHome | Archive | Shop\n{EN}“{FR.strip()}”\nWe place files. OK. Accept | Settings\n© 2020 · Contact\n"
    assert " ".join(s for _, s in passages(page)) == EN.strip()
    assert passages("") == []


def test_infer_drops_languages_that_explain_nothing():
    scores = np.log(np.array([[0.9, 0.1], [0.8, 0.2], [0.45, 0.55], [1e-9, 1.0]]))
    post, share = infer(scores, np.array([0, 0, 0, 1]), np.array([50.0, 50.0, 20.0, 90.0]))
    assert post.argmax(axis=1).tolist() == [0, 0, 0, 1] and share[0, 1] == 0


def test_segments(spark):
    samples = spark.createDataFrame(SAMPLES + [(None, "x"), ("fr", None)], "lang string, text string")
    model = fit(samples)
    assert model.languages == ["en", "fr", "ru"]
    rows = [(1, EN * 3, "x"), (2, EN * 3 + "\n" + FR * 3, "x"), (3, None, "x"), (4, "", "x"), (5, RU.encode().decode("cp1251", errors="replace") * 4, "x"), (6, EN * 3000, "x"), (None, EN, "x"), (7, "a" * 30_000 + ".", "x")]
    found = segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, "doc_id", "text")
    got = {(r.id, r.segment): (r.lang, r.chars) for r in found.filter("id < 7").collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): "en", (2, 1): "en", (2, 2): "fr", (5, 1): "ru", (6, 1): "en"}
    assert abs(got[5, 1][1] - 4 * len(RU)) < 8
    share = {(r.id, r.lang): r.share for r in document_languages(found).collect()}
    assert 0.4 < share[2, "fr"] < 0.6 and share[1, "en"] == 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert segments(none, Model([("en", EN)]), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        fit(none.withColumnRenamed("doc_id", "lang").limit(0).selectExpr("cast(lang as string) as lang", "text"))
