"""Porter stems: published pairs, edge words; folded synonyms."""

from pyspark.sql import functions as F

from newsloom.functions import stems

# Word and final stem, from the published description of the algorithm and its sample vocabulary.
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil yielding yield y y is is a a news new apologies apolog""".split()


def test_published_pairs(spark):
    pairs = dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    got = {r.word: r.stem for r in stems.porter(spark.createDataFrame([(w,) for w in pairs], "word string"), "word").collect()}
    assert got == pairs


def test_edge_words_and_clashing_names(spark):
    rows = [(None, 1), ("", 2), ("s", 3), ("eed", 4), ("ing", 5), ("yes", 6)]
    got = {r.w: r.stem for r in stems.porter(spark.createDataFrame(rows, "w string, past int"), "w").collect()}
    assert got == {None: None, "": "", "s": "s", "eed": "eed", "ing": "ing", "yes": "ye"}


def test_stems_of_arrays(spark):
    rows = spark.createDataFrame([(1, ["cats", "cat", "cat"]), (2, []), (3, None)], "id int, words array<string>")
    assert [tuple(r) for r in stems.stemmed(rows, "words", ["id"]).collect()] == [(1, "cat")]


def test_longer_synonyms_come_first(spark):
    text = spark.range(1).select(stems.fold_synonyms(F.lit("The Republic of Congo, Congo"), [("congo", "drc"), ("republic of congo", "drc")])).collect()[0][0]
    assert text == "the drc, drc"
