import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from collatio.functions import distance as D
from collatio.functions import kernels as K
from collatio.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("v")).first()["v"]


TIERS = [
    ("L0", "  Daſs  er\nkam ", "Daſs er kam"), ("L1", "Daſs die Bruͤder", "Dass die Brüder"), ("L1", "Straße", "Strasse"), ("L1", "ein [?] Wort [unsicher]", "ein Wort unsicher"), ("L1", "ﬅur", "stur"),
    ("L1", "Rats-\nprotokoll", "Ratsprotokoll"), ("L1", "Rats¬\nprotokoll", "Ratsprotokoll"), ("L2", "Vnd Jtem", "und item"), ("L0", "| Eiche | 12 |\n|---|---:|\n| Buche | 7 |", "Eiche 12 Buche 7"),
    ("L1", "clausu[-]\nlis", "clausu- lis"), ("L0", "a b c\u001cd", "a b c d"), ("L0", "a\n--\nb", "a b"), ("L0", None, ""), ("L2", "", ""), ("L1", "⟨wort⟩ ẞ", "wort SS"),
]


@pytest.mark.parametrize("tier,raw,want", TIERS)
def test_tiers(spark, tier, raw, want):
    assert one(spark, lambda c: T.normalize(c, tier), raw) == want
    assert K.normalize(raw, tier) == want


def test_unknown_tier():
    with pytest.raises(ValueError):
        T.normalize(None, "L9")


def test_column_and_kernel_agree(spark):
    odd = ["a-\n\n-b", " x | y |z\n***\n- - -\nend ", "ſʃßẞﬃ uͤ Uͤ vVjJ", "[a] [b c] ⟨d⟩ (?) [...] […]", "\r\nA\rB\r\n", "é ẞ", "=\n=\nx=\ny", "|", "--", "a --- b"]
    for tier in T.TIERS:
        got = [r["v"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string").select("i", T.normalize(F.col("s"), tier).alias("v")).orderBy("i").collect()]
        assert got == [K.normalize(s, tier) for s in odd], tier


def test_tokens_and_lines(spark):
    assert one(spark, T.tokens, "") == [] and one(spark, T.tokens, None) == []
    assert one(spark, T.tokens, " a b  c ") == ["a", "b", "c"]
    assert one(spark, T.split_lines, " a \r\n\n b\r c") == ["a", "b", "c"]
    assert one(spark, T.strip_token, "„Harzburg“,") == "Harzburg"
    assert one(spark, T.numeral_tokens, "den 25. Januar 1923, 25 fl.") == ["25", "1923", "25"]


def test_clean(spark):
    def clean(s):
        return T.clean(spark.createDataFrame([(s,)], "s string"), "s", "v").first()["v"]

    assert clean("Here is the transcription:\n```\n**Concl:** Sub Consuetis\n```\n\nNote: the page is damaged.") == "Concl: Sub Consuetis"
    assert clean("## Title\n\n\n\n<b>x</b> __y__  ") == "Title\n\nx y"
    assert clean("Sure:") == "Sure:" and clean(None) == "" and clean(" \n ") == ""
    assert clean("a\n\nb") == "a\n\nb"


def test_rates(spark):
    assert one(spark, D.cer, "abcd", "abxd") == 0.25 and one(spark, D.wer, "a b c d", "a b d") == 0.25
    assert one(spark, D.cer, "", "") == 0 and one(spark, D.cer, "", "x") == 1
    assert one(spark, D.char_edits, "ſeeʆ", "seel") == 2
    assert one(spark, D.char_edits, "a" * 2000, "b" * 1990) == 2000
    assert one(spark, D.similarity, "", "") == 1


def test_block_text_and_unwrap(spark):
    assert one(spark, T.block_text, "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == "a | b |\nc |"
    assert one(spark, T.unwrap, " <output> x\ny </output> ") == "x\ny"
    assert one(spark, lambda c: T.fill("{{a}} {x}", x=c), "v") == "{a} v"


def test_texts_stay_in_the_jvm(spark, tmp_path):
    """No text goes to Python, whose batches grow with the texts, and a tier is made once, however many columns read it."""
    from collatio.plans import catalog

    spark.createDataFrame([(1, "en", "x7 é")], "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("step_nfc", "norm_l0", "norm_l1", "norm_l2", "numeral_f1"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and plan.count("compose") == 1, (name, plan)


def test_nfc(spark):
    odd = [None, "", "abc", "é", "ọ̈ ᅡ", "각", "Å क़", "\U0001d15e\U0001f600", "uͤ", "a\u0000́"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, s string").select("i", T.nfc(F.col("s")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [s if s is None else unicodedata.normalize("NFC", s) for s in odd]


def test_white_space(spark):
    """Every kind of it, at ends, between words and alone; a long run costs its length, not its square."""
    assert set(T.WHITE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    texts = [f"{a}x{b}{a}y{b}\n{b}" for a in T.WHITE for b in T.WHITE] + [T.WHITE, "​x⁠"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", T.whitespace(F.col("s")).alias("w"), T.strip(F.col("s")).alias("p"), T.tokens(F.col("s")).alias("t"), T.split_lines(F.col("s")).alias("l")).orderBy("i").collect()
    for s, r in zip(texts, rows, strict=True):
        assert (r["w"], r["p"], r["t"], r["l"]) == (" ".join(s.split()), s.strip(), s.split(), K.split_lines(s)), s
    began = time.time()
    assert one(spark, lambda c: T.normalize(c, "L1"), "a" + " " * 300_000 + "b́  " * 20_000 + "c") == "a" + " b́" * 20_000 + " c"
    assert time.time() - began < 15
