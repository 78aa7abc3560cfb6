import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language as L, queries

#: Frequent words; a word that several languages share stands in all their lists.
WORDS = {
    "en": "the of and to in was that by no had without for is not on been as which a",
    "de": "der die das und den des nicht mit von im in dem auf zu ist hat aus kein ohne",
    "fr": "le la les des et du de une que pour est par au sans dans aux ce ne avait a",
    "pl": "i w na nie z do się że przez o oraz jest od za po mimo bez dnia",
    "nl": "de het een van en in niet dat die voor is op met aan zonder werd geen heeft",
    "it": "il la lo le del della di che e per in non una con si nel alla stato è gli ha a",
    "es": "el la los las del de que y por en no una para con se lo sin al había a",
    "pt": "o a os as do da dos das de que e por em não uma para com se no na foi ao sem",
}


def by_words(text):
    found = {k: sum(w in v.split() for w in text.lower().split()) for k, v in WORDS.items()}
    best = sorted(found.items(), key=lambda x: -x[1])
    return best[0][0] if best[0][1] >= best[1][1] + 3 else None


@pytest.fixture(scope="module")
def net(spark, sf01):
    return L.fit(spark.read.parquet(f"{sf01}/documents.parquet"))


def test_labels_in_any_spelling():
    for text, code in {"de": "de", " DE ": "de", "ger": "de", "deu": "de", "de-AT": "de", "en_GB": "en", "POL": "pl", "nld": "nl"}.items():
        assert L.label_code(text) == code
    assert all(L.label_code(x) is None for x in (None, "", " ", "??", "und", "unknown", 5))


def test_held_out_paragraphs(spark, net):
    """Documents of another table than the one fitted on, against lists of frequent words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 10 = 3"))
    texts = [r.text for r in docs.select("text").collect()]
    pairs = [(by_words(p), p) for t in texts for _, p in L.paragraphs(t)]
    pairs = [(k, p) for k, p in pairs if k]
    scores, _, _ = L.Reader(net).text_scores([L.words_only(p) for _, p in pairs])
    right = np.mean([net.classes[b] == k for (k, _), b in zip(pairs, scores.argmax(axis=1))])
    assert len(pairs) > 3000
    assert right > 0.99, right


def test_found_cases(spark, sf01):
    rows = [tuple(r) for r in queries.p9_found(spark, sf01).collect()]
    assert len(rows) == len(set(rows)) and {r[2] for r in rows} <= set(WORDS)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    flagged = {r[0] for r in rows if r[1] == 0}
    for k, r in docs.items():
        if L.label_code(r.lang) is None and any(by_words(p) for _, p in L.paragraphs(r.text)):
            assert k in flagged
    told = [(lang, by_words(dict(L.paragraphs(docs[d].text))[n])) for d, n, lang in rows if n]
    told = [x for x in told if x[1]]
    assert len(told) > 10 and np.mean([a == b for a, b in told]) > 0.97


def test_paragraphs():
    text = "Court\nPage 1 of 2 — A-2001-0000001\n[4] One two.\nmore, see\n[17] of it.\n- Page 2 -\n[5]\tThree.\n\n[6] [REDACTED]\nGiven under the seal of the court"
    assert L.paragraphs(text) == [(4, " One two.\nmore, see\n[17] of it."), (5, "\tThree."), (6, " [REDACTED]")]
    assert [n for n, _ in L.paragraphs("Rn. 1 Eins\r\nRn. 2 Zwei\rRn. 3 Drei")] == [1, 2, 3]
    assert [n for n, _ in L.paragraphs("¶ 7 a\n¶ 8 b\n(1) c")] == [7, 8]
    assert L.paragraphs(None) == L.paragraphs("") == L.paragraphs("no numbers at all") == []
    assert L.words_only("[name] *** ██ XXXXX").strip() == ""


def test_cases(spark, net):
    long = "The court held that the appeal was dismissed without any further reasons. " * 3000
    rows = [
        (1, "de", "1. The claimant has lost the case.\n2. The court dismissed the appeal for want of jurisdiction.\n3. Der Kläger hat die Sache verloren und das Gericht hat nicht entschieden.", "x"),
        (2, None, None, "x"), (3, "", "", "x"), (4, "en", "   \n ", "x"), (5, "en", "███ ██", "x"), (6, None, long, "x"),
        (7, "EN ", "1. ***\n2. [REDACTED]", "x"), (1, "de", "The same id again without numbers.", "x"), (None, "en", "Without an id the row stays.", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, para_no string")
    got = L.assign_languages(df, net).collect()
    main = {r.doc_id: r for r in got if r.para_no == 0 and r.numbered}
    assert main[1].lang == "en" and main[1].label == "de" and 0 < main[1].confidence <= 1
    assert [(r.para_no, r.lang) for r in got if r.doc_id == 1 and r.para_no] == [(1, "en"), (2, "en"), (3, "de")]
    other = {r.doc_id: r for r in got if not r.numbered}
    assert all(other[k].lang is None for k in (2, 3, 4, 5, 7)) and other[6].lang == "en" and other[6].words > 30_000
    assert len([r for r in got if r.doc_id is None]) == 1
    assert L.assign_languages(df.limit(0), net).count() == 0
    with pytest.raises(ValueError):
        L.fit(df.limit(0))


def test_label_codes_on_both_sides(spark):
    labels = ["de", " DE ", "ger", "de-AT", "en_GB", "POL", "\tnl ", "", " ", "??", "und", "12", None, "fr FR", "\u00a0it"]
    rows = spark.createDataFrame([(x,) for x in labels], "l string").select("l", L.code_column(F.col("l")).alias("c")).collect()
    assert all(r.c == L.label_code(r.l) for r in rows), [(r.l, r.c) for r in rows if r.c != L.label_code(r.l)]


def test_rare_languages_are_classes_and_wrong_codes_are_not(spark, sf01, net):
    rng = np.random.default_rng(1)
    stems = ["ja", "on", "ei", "tuomio", "oikeus", "kantaja", "vastaaja", "hakemus", "kuitenkin", "asiassa", "mukaan", "sopimuksen", "velvollisuus", "käsittely", "päätös", "hylätään"]
    text = lambda: "\n".join(f"{i}. " + " ".join(rng.choice(stems, 40)) for i in range(1, 5))
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang", "text")
    rare = spark.createDataFrame([(10**6 + i, "fin", text()) for i in range(4)], "doc_id long, lang string, text string")  # 0.4 %
    wrong = docs.where("doc_id % 97 = 0").withColumn("lang", F.lit("sv"))
    german = docs.where("doc_id % 23 = 1 and lang = 'de'").withColumn("lang", F.lit("da"))  # a code that is put on one language only
    rest = docs.where("doc_id % 97 != 0 and not (doc_id % 23 = 1 and lang <=> 'de')")
    both = L.fit(rest.unionByName(rare).unionByName(wrong).unionByName(german))
    assert german.count() > 1 and "da" not in both.classes
    assert "fi" in both.classes and "sv" not in both.classes and set(net.classes) < set(both.classes)
    told = L.assign_languages(spark.createDataFrame([(1, "xx", text())], "doc_id long, lang string, text string"), both).where("para_no = 0").first()
    assert told.lang == "fi"


def test_wrong_codes_with_as_many_sampled_documents_are_no_classes(spark):
    """In a large table a code on a hundredth of the Dutch documents fills its share of the sample as Dutch does."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(30))
    code = L.code_column(F.col("lang"))
    lang = F.when((code == "nl") & (part < 3), "af").when((code == "pl") & (part < 4), "cs").when((code == "pl") & (part < 8), "sk").otherwise(F.col("lang"))
    wrong = docs.withColumn("lang", lang)
    counts = {r.lang: r["count"] for r in wrong.groupBy("lang").count().collect()}
    assert all(counts[c] >= 60 for c in ("af", "cs", "sk")), counts
    net = L.fit(wrong, documents=60)
    assert net.classes == sorted(WORDS)
    text = "1. De rechtbank heeft het hoger beroep niet ontvankelijk verklaard.\n2. De getuige heeft de factuur bevestigd zonder nadere redenen te geven."
    rows = L.assign_languages(spark.createDataFrame([(1, "af", text)], "doc_id long, lang string, text string"), net).collect()
    assert {r.lang for r in rows} == {"nl"}


def test_any_space_parts_words(spark, net):
    german = "Das Gericht prüfte die Klausel zur verspäteten Lieferung nach Anhörung beider Parteien."
    count = lambda t: int(L.cut_windows([L.words_only(t)])[2].sum())
    assert all(count(s + german.replace(" ", s)) == count(german) == 12 for s in (" ", "  ", "\u00a0", "\u2003", "\u202f", "\u3000", "\n"))
    text = "\n".join([*(f"{i}.\u2003{german}".replace(" ", "\u00a0") for i in (1, 2, 3)), "4. The court dismissed the appeal for want of jurisdiction.", "5. The parties were heard on 2 May 2001."])
    got = {r.para_no: r.lang for r in L.assign_languages(spark.createDataFrame([(1, "de", text)], "doc_id long, lang string, text string"), net).collect()}
    assert got == {0: "de", 1: "de", 2: "de", 3: "de", 4: "en", 5: "en"}


def test_documents_whose_label_is_denied_are_not_trained_on(spark, sf01, monkeypatch):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang", "text")
    french = (L.code_column(F.col("lang")) == "fr") & (F.pmod("doc_id", F.lit(8)) == 3)
    wrong = docs.where(french).select("doc_id", F.lit("it").alias("code"), "text").toPandas()
    calls, train = [], L.train
    monkeypatch.setattr(L, "train", lambda *a: calls.append(a) or train(*a))
    L.fit(docs.withColumn("lang", F.when(french, "it").otherwise(F.col("lang"))))
    windows, labels, classes = calls[-1]
    italian = {w.tobytes() for w in windows[labels == classes.index("it")]}
    denied = {w.tobytes() for w in L.as_matrix([bytes(x) for x in next(L._sample(iter([wrong]))).window])}
    assert len(denied) > 50 and len(denied & italian) < 0.1 * len(denied), (len(denied), len(denied & italian))


def test_saved_network_tells_the_same(spark, net, tmp_path):
    L.save(net, spark, f"file://{tmp_path}/net")
    again = L.restore(spark, f"file://{tmp_path}/net")
    w = L.as_matrix([b"the court held that the appeal", b"das gericht hat entschieden"])
    assert again.classes == net.classes and (again.probabilities(w) == net.probabilities(w)).all()
