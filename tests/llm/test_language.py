import random

import pyarrow as pa

from lodestrata.llm import language as L

TEXT = {
    "en": "The planning office published the figures on water withdrawal. The municipal council rejected the building permit for the second hall. The local newspaper doubts that the noise limits will be kept.",
    "fr": "Le service d'urbanisme a publié les chiffres des prélèvements d'eau. Le conseil municipal a refusé le permis pour le deuxième bâtiment. Le journal local doute que les seuils de bruit soient respectés.",
    "de": "Das Bauamt veröffentlichte die Zahlen zur Wasserentnahme im Sommer. Der Gemeinderat lehnte die Genehmigung für die zweite Halle ab. Die Lokalzeitung bezweifelt die Einhaltung der Lärmgrenzwerte.",
    "es": "La oficina de urbanismo publicó las cifras de captación de agua. El pleno municipal rechazó la licencia para la segunda nave. El periódico local duda de que se cumplan los límites de ruido.",
    "it": "L'ufficio urbanistico ha pubblicato i dati sui prelievi d'acqua. Il consiglio comunale ha respinto il permesso per il secondo capannone. Il giornale locale dubita che i limiti di rumore siano rispettati.",
    "nl": "De afdeling ruimtelijke ordening heeft de cijfers over de wateronttrekking gepubliceerd. De gemeenteraad heeft de vergunning voor de tweede hal geweigerd. De lokale krant betwijfelt of de geluidsgrenzen worden gehaald.",
}


def slow_phrases(text, corpus):
    n, i = 1, 0
    start = 0
    while i < len(text):
        if text[start : i + 1] in corpus:
            i += 1
        elif i == start:
            n, i, start = n + 1, i + 1, i + 1
        else:
            n, start = n + 1, i
    return n


def test_phrases_equal_a_plain_search():
    rng = random.Random(3)
    corpus = {g: "|".join(L.reduced(L.sentences(t))) for g, t in TEXT.items()}
    flat, roots = L.automata(corpus)
    probes = ["".join(rng.choice("abcde rn'") for _ in range(rng.randint(1, 60))) for _ in range(60)] + [s for t in TEXT.values() for s in L.reduced(L.sentences(t))]
    got = L.phrase_counts(probes, flat, roots)
    for k, probe in enumerate(probes):
        for j, g in enumerate(L.LANGUAGES):
            parts = corpus[g].split("|")
            joined = type("C", (), {"__contains__": lambda self, x, parts=parts: any(x in p for p in parts)})()
            assert got[k, j] == slow_phrases(probe, joined), (probe, g)


def test_sentences():
    assert len(L.sentences("Title\n\n<p>One two three four five six.</p> A b.\nhttps://x.example/a/b/c")) == 1
    assert len(L.sentences("El gestor de la red aplazó la votación. « not in my backyard ». « The council has rejected the whole permit today. »")) == 2
    assert L.sentences("") == [] and L.sentences("no end sign here at all") == []


def test_documents(spark):
    rows = [(k, g, TEXT[g]) for k, g in enumerate(L.LANGUAGES)] * 3
    training = L.cleaned([(g, t) for _, g, t in rows] + [("en", TEXT["fr"])])
    mixed = TEXT["fr"] + "\n\n" + "The municipal council rejected the building permit."
    docs = [(100, "French", TEXT["fr"].upper()), (101, "fr", mixed), (102, None, TEXT["nl"]), (103, "de", None), (104, "de", ""), (None, "de", TEXT["de"]), (105, "pt", (TEXT["es"] + " ") * 300), (100, "French", TEXT["fr"].upper())]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string").selectExpr("*", "'x' as main", "'y' as label")
    got = {(r.doc_id, r.label, r.lang, r.main, r.n_langs) for r in L.segment_languages(df, "doc_id", "lang", "text", training).collect()}
    assert got == {(100, "fr", "fr", "fr", 1), (101, "fr", "fr", "fr", 2), (101, "fr", "en", "fr", 2), (102, None, "nl", "nl", 1), (105, None, "es", "es", 1)}
    rows = [(1, None, "(" + TEXT["de"] + ")"), (2, None, "Titel\nDer Gemeinderat lehnt die Genehmigung für das Gebäude ab"), (3, None, "12 345"), (4, "de", "<p></p>")]
    extra = {(r.doc_id, r.lang, r.n_sentences > 0) for r in L.segment_languages(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), "doc_id", "lang", "text", training).collect()}
    assert extra == {(1, "de", True), (2, "de", False)}
    assert L.segment_languages(df.where("false"), "doc_id", "lang", "text", training).count() == 0


def test_labels(spark):
    vals = ["en", "EN ", "en-GB", "eng", "English", "Deutsch", "nl_BE", "pt", "xx", "", None, "mul", "français"]
    df = spark.createDataFrame([(v,) for v in vals], "l string").select(L.language_of_label(df_col()))
    assert [r[0] for r in df.collect()] == ["en", "en", "en", "en", "en", "de", "nl", None, None, None, None, None, "fr"]


def df_col():
    from pyspark.sql import functions as F

    return F.col("l")


def test_held_out_accuracy():
    train = {g: "|".join(L.reduced(L.sentences(t))[:2]) for g, t in TEXT.items()}
    flat, roots = L.automata(train)
    held = [(g, L.reduced(L.sentences(t))[2]) for g, t in TEXT.items()]
    best = L.phrase_counts([s for _, s in held], flat, roots).argmin(1)
    assert sum(L.LANGUAGES[b] == g for b, (g, _) in zip(best, held)) >= 5
    assert pa.__version__
