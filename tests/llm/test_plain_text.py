import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import plain_text as p

CASES = [
    ("Stіwu", "Stiwu"), ("Ｒｅｌｅｖｅ́ ｄｅｓ", "Relevé des"), ("Sаnta　Deden", "Santa Deden"), ("Œ​uvry-Kïwe‍x", "Œuvry-Kïwex"), ("d'eau IΙ", "d'eau II"), ("𝚁𝚎gistro", "Registro"), ("Cизaвο", "Сизаво"),
    ("993O7", "99307"), ("Regiﬆre Ⅱ", "Registre II"), ("a b", "a b"), ("tab\there", "tab here"), ("Legrethłόw", "Legrethłów"), ("각", "각"), ("\U000114b9\U000114ba", "\U000114bb"),
]
PLAIN = ["", "Τοφεζιπε", "Лимаиижуград", "L’stúzos — «x» “y” Straße łœ", "Château-Stúges (XA)", "é à ü", "Ζυκα", "bât. B – 2", "10 000"]


def test_cases():
    assert p.plain_array(pa.array([a for a, _ in CASES])).to_pylist() == [b for _, b in CASES]
    assert p.plain_array(pa.array(PLAIN)).to_pylist() == PLAIN


def test_a_good_letter_is_not_spoiled():
    for a, b in [("Pαris", "Paris"), ("ρaris", "paris"), ("campυs", "campus"), ("Ꮇunich", "Munich"), ("και", "και"), ("Πaρις", "Παρις"), ("Zυκα", "Ζυκα"), ("αυτό", "αυτό"), ("Сaнкт", "Санкт")]:
        assert p.plain_array(pa.array([a])).to_pylist() == [b], a


def test_nulls_slices_and_empty():
    a = pa.array(["x", None, "ＡＢ", "", None, "é"])
    assert p.plain_array(a).to_pylist() == ["x", None, "AB", "", None, "é"]
    assert p.plain_array(a.slice(1, 3)).to_pylist() == [None, "AB", ""]
    assert p.plain_array(pa.array([], pa.string())).to_pylist() == []


def test_long_texts_are_taken_whole():
    text = "ｆoo bár " * 400_000
    assert p.plain_array(pa.array([text, "ｂ"])).to_pylist() == ["foo bár " * 400_000, "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Co")), max_size=12), max_size=8))
def test_marks_compose_as_defined(texts):
    """Against a plain version, character by character, without the look-alikes."""
    t = p.tables()
    cp, row = p.decode(pa.array(texts, pa.string()))
    assert p.encode(cp, row, len(texts)).to_pylist() == texts
    cp, row = p._compose(p._expand(cp, row, t.length, t.start, t.data)[0].astype("int32"), p._expand(cp, row, t.length, t.start, t.data)[1], t)
    want = [unicodedata.normalize("NFC", "".join(c if ord(c) >= p.TOP or (r := p._replacement(ord(c))) is None else r for c in x)) for x in texts]
    low = [k for k, x in enumerate(texts) if all(ord(c) < p.TOP for c in x)]
    got = p.encode(cp, row, len(texts)).to_pylist()
    assert [got[k] for k in low] == [want[k] for k in low]


def test_once_is_enough():
    once = p.plain_array(pa.array([a for a, _ in CASES] + PLAIN))
    assert p.plain_array(once).to_pylist() == once.to_pylist()


def test_query(spark):
    df = spark.createDataFrame([(1, "ａ", "x"), (2, "a", "x"), (3, None, "x"), (None, "ａ", "x")], "k int, t string, plain string")
    assert [tuple(r) for r in p.not_plain(df, F.col("k"), F.col("t")).collect()] == [("1", "ａ", "a")]
    assert p.not_plain(df.where("false"), F.col("k"), F.col("t")).count() == 0
