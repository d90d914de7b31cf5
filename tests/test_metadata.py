"""The Danish lexicon's fields on a hand-made decision."""

from docketry.functions import lexicon_da


def test_metadata(spark):
    text = "Huset er opført i 1934. Taget fra 1988 har undertag af zink, og der er fugt og råd efter slid og ælde, jf. lov nr. 606 og FAL. Udskiftning."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    a, b = lexicon_da.metadata(df, ["doc_id"]).orderBy("doc_id").collect()
    assert (a.building_parts, a.causes, a.consequences, a.materials, a.remedies) == (["undertag"], ["slid og ælde", "fugt/vand"], ["råd"], ["zink"], ["udskiftning"])
    assert a.construction_years == [1934, 1988] and a.laws == ["lov nr. 606", "forsikringsaftaleloven"]
    assert not any(b[1:])
