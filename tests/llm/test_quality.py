"""Text quality statistics: exact values, tails, merged sketches, and the defined cases."""

import pytest
from pyspark.sql import functions as F

from voltloom.llm.quality import MEASURES, grade, merge_sketches, sketches, text_statistics

SCHEMA = "id long, text string, t string, w int, language string"
PROSE = [
    "I have been writing down what the meter does on cold mornings, and I still do not know why it is so loud.",
    "We replaced the cable last week because the old one was never closed properly, but nothing has changed.",
    "Has anyone seen the boiler behave like this when the sun goes down? You should check it before you blame us.",
    "thanks that helped me a lot with the charger but they told us that it would pay for itself so we are happy",
    "Je pense que le voisin n'est pas en cause, et je ne comprends pas pourquoi il est si tard pour nous.",
    "> On cold mornings it used more than 21 units,\n> so we switched it off for a night.\n\nWhat do you think about that?",
]
JUNK = [
    "", "   ", None, "[deleted]", "- valve;\n- fuse;\n- small relay;\n- grey clamp;", "| a | b |\n|---|---|\n| 12 | 33 |\n| 84.2 | 91 |", "2025-01-01 10:00:00 254 W 221.2 V\n2025-01-02 10:00:00 354 W 222.2 V",
    "shunt, gasket, breaker, bracket, rail, busbar, relay83, fuse32, sensor", "kveaj ktk weczdk efklsq rsllv qrlcz jvkzch ddkq rwdw", "@)#!@~$!-%=@$><$//]~%= _]`<$+/^(+`(-#}+`+", "<div></div><br/>[b][/b]&nbsp;{{tpl}}", "😀💡👍 🏠⚡🔥", "up up up up up up up up up up up",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)


def test_values(spark):
    got = text_statistics(frame(spark, ["You pay 12 for it.\nfoo bar baz!\n<b>x</b>"]), "id", "text").first()
    assert (got.words, got.language, got.distinct_common) == (8, "en", 2)
    assert got.mean_word_length == pytest.approx((3 + 3 + 3 + 2 + 3 + 3 + 3 + 1) / 8)
    assert got.end_punct_share == pytest.approx(2 / 3)
    assert got.common_share == pytest.approx(2 / 8)
    assert got.digit_share == pytest.approx(2 / 25) and got.symbol_share == pytest.approx(2 / 25)


def test_prose_is_told_from_junk(spark):
    texts = PROSE * 6 + JUNK
    got = {x.id: x.prose for x in grade(text_statistics(frame(spark, texts), "id", "text")).collect()}
    assert [got[i] for i in range(len(texts))] == [True] * 6 * len(PROSE) + [False] * len(JUNK)


def test_sketches_merge(spark):
    stats = text_statistics(frame(spark, PROSE * 10), "id", "text")
    whole = sketches(stats)
    parts = merge_sketches(sketches(stats, (F.col("id") % 3).alias("p")), "language")
    read = lambda t: {x.language: tuple(x)[1:] for x in t.select("language", "documents", *[F.kll_sketch_get_quantile_double(f"k_{m}", F.lit(0.5)) for m in MEASURES]).collect()}
    assert read(whole) == read(parts)
    assert grade(stats, parts).where("not prose").count() == 0


def test_other_languages_are_measured_not_refused(spark):
    other = ["Questa mattina il contatore faceva un rumore strano, quindi ho chiamato la ditta e loro hanno promesso una visita.", "Non capisco perche la bolletta sia raddoppiata dopo che abbiamo cambiato il vecchio contatore con quello nuovo."]
    junk = ["12 33 44 | 55 12 | 99 12 33 44 55", "valvola\nfusibile\nmorsetto\nstaffa 12\nsensore 9"]
    texts = [(t, "en" if i % 5 else None) for i, t in enumerate(PROSE * 8)] + [(t, "it") for t in other * 4 + junk]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "id long, text string, lang string")
    got = grade(text_statistics(df, "id", "text", label=F.col("lang"))).orderBy("id").collect()
    assert [x.prose for x in got] == [True] * (len(texts) - 2) + [False] * 2
    assert {x.language for x in got[-10:]} == {"it"} and not any(x.listed for x in got[-10:])
    assert all(0 <= x[f"p_{m}"] <= 99 for x in got for m in MEASURES)


def test_cases(spark):
    assert grade(text_statistics(frame(spark, []), "id", "text")).count() == 0
    only = grade(text_statistics(frame(spark, JUNK[:-1]), "id", "text")).collect()
    assert len(only) == len(JUNK) - 1 and not any(x.prose for x in only if not x.common_share)
    long = grade(text_statistics(frame(spark, [" ".join(PROSE) * 300, *PROSE * 6, "x" * 300_000]), "id", "text")).orderBy("id").collect()
    assert long[0].words > 25_000 and [long[0].prose, long[-1].prose] == [True, False]


@pytest.mark.parametrize("copies", [1, 18, 40])
def test_flags_do_not_depend_on_the_share_of_junk(spark, copies):
    parts = "shunt gasket breaker bracket rail busbar relay fuse sensor clamp valve washer flange bolt spool"
    texts = [t for t in PROSE if t.isascii() and "Je " not in t] * 7 + [f"{parts} and {parts} with"] * copies
    got = [x.prose for x in grade(text_statistics(frame(spark, texts), "id", "text")).orderBy("id").collect()]
    assert got == [True] * (len(texts) - copies) + [False] * copies
