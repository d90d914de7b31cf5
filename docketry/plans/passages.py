"""Passages, outcomes, quotations and stems over cases dealt to documents, as in ``danish``; the SQL has the results by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import rules
from docketry.functions.snowball_da import stemmed
from docketry.operators import ordered, passages, reasoning
from docketry.plans.danish import cases, joined
from docketry.plans.registry import query, table
from docketry.sources import documents

cases("decided_outcomes", "title said given", "outcome", [
    ("Klager over tag. Selskab medhold.", "", "", "Ikke medhold"), ("Fugt. Klager delvis medhold.", "", "", "Delvis medhold"), ("Klageren medhold.", "", "", "Medhold"), ("Sag afvist.", "", "", "Afvist"),
    ("Uden resultat", "Derfor bestemmes: Klagen tages til følge.", "", "Medhold"), ("Uden resultat", "B e s t e m m e s : Klagen kan ikke tages til følge.", "", "Ikke medhold"), ("Uden resultat", "Nævnet kan ikke viderebe- handle sagen.", "", "Afvist"),
    ("Uden resultat", "Klageren får i øvrigt ikke medhold.", "", "Delvis medhold"), ("Uden resultat", "Intet.", "Medhold", "Medhold"), ("Uden resultat", "Intet.", "Andet", "Ukendt"), (None, None, None, "Ukendt"),
], lambda title, said, given: [rules.outcome(title, said, given)])

cases("key_sections", "said", "kept", [
    ("x\n## Andet\nintet\n## Konklusion\nDækket.", "[KONKLUSION]\nDækket."), ("\n### Afgørelse\nJa.\n## Begrundelse\nFordi.", "[BEGRUNDELSE]\nFordi.\n\n[AFGØRELSE]\nJa."), ("Ingen afsnit", "Ingen afsnit"), (None, ""),
], lambda said: [passages.key_sections_of(said, 100)])

cases("statute_parts", "said", "parts", [
    ("Kapitel 1\nFormål\n§ 1. Loven gælder.\nMere.\n§ 2 a. Undtaget.", "1|1|Formål|Loven gælder. Mere.;2a|1|Formål|Undtaget."), ("Kapitel 2 Landzoner\n§ 35 Tilladelse", "35|2|Landzoner|Tilladelse"), ("Uden paragraf", ""), (None, ""),
], lambda said: [joined(F.transform(passages.statutes_of(said), lambda x: F.concat_ws("|", x["para"], x["chapter"], x["chapter_title"], x["text"])))])

cases("cited_claims", "said", "claims", [
    ("Taget er utæt [Kilde 1]. Det er dækket [Kilde 2-3].", "1|Taget er utæt [Kilde 1].;2|Det er dækket [Kilde 2-3].;3|Det er dækket [Kilde 2-3]."), ("<p>Ja [Kilder 4, 5]</p><p>Nej</p>", "4|Ja [Kilder 4, 5];5|Ja [Kilder 4, 5]"), ("Uden kilder.", ""), (None, ""),
], lambda said: [joined(F.transform(passages.claims_of(said), lambda x: F.concat_ws("|", x["source"].cast("string"), x["claim"])))])

cases("page_contents", "html", "said", [
    ("<body><nav>menu menu menu menu</nav><article><p>Sagen om tag</p></article><footer>bund</footer></body>", "Sagen om tag"), ("<div>kort</div><div>en længere <b>tekst</b></div>", "en længere tekst"), ("<body><script>x</script>Kun dette</body>", "Kun dette"), (None, ""),
], lambda html: [passages.main_content_of(html)])

cases("index_stems", "said", "stems", [
    ("Afgørelser planloven", "afgør;planlov"), ("rodvækst rødderne", "rødder;rødder"), ("løsladt underfundig", "løslad;underfund"), (None, ""),
], lambda said: [joined(stemmed(F.coalesce(said, F.lit(""))))])

cases("filled_budgets", "sizes", "taken apart", [("5;7;3", "1;3", "1"), ("9;1", "1", "1"), ("10;4;4", "2;3", "2"), ("2;2;2", "1;2;3", "1;2"), ("10", "", "")], lambda sizes: [
    joined(F.transform(ordered.filled(F.transform(F.split(sizes, ";"), lambda x: x.cast("int")), 9), lambda x: x.cast("string"))), joined(F.transform(ordered.filled(F.transform(F.split(sizes, ";"), lambda x: x.cast("int")), 9, 3), lambda x: x.cast("string")))])

cases("quotations", "said", "found", [
    ('"kort" og "en meget længere ordret gengivelse"', "en meget længere ordret gengivelse"), ("»Nævnet finder at taget var utæt« og “selskabet skal betale hele beløbet nu”", "selskabet skal betale hele beløbet nu;Nævnet finder at taget var utæt"),
    ('"en lang gengivelse af noget [Kilde 2] herfra"', ""), (None, ""),
], lambda said: [joined(passages.quotes_of(said))])

cases("quotation_support", "quote source", "held", [
    ("Taget  var utæt ved overtagelsen", "Nævnet fandt, at taget var\nutæt ved overtagelsen.", True), ("en længere ordret … gengivelse af teksten", "En længere ordret, men her udvidet, gengivelse af teksten.", True),
    ("taget-var utæt, ved overtagelsen", "At taget var utæt ved overtagelsen står fast", True), ("noget helt andet end det der står i kilden", "Kilden siger noget.", False), ("selskabet skal betale hele beløbet straks og uden videre forbehold", "selskabet skal betale hele beløbet straks og uden ophold", True), ("kort", None, False),
], lambda quote, source: [passages.supported_of(quote, source)])

cases("file_kinds", "hexed", "kind said", [
    ("255044462D312E34", "pdf", ""), ("504B030414000000", "docx", None), ("D0CF11E0A1B11AE1AA", "doc", None), ("0A3C68746D6C3E", "html", "\n<html>"), ("48656A", "text", "Hej"), (None, None, None),
], lambda hexed: [documents.kind(F.unhex(hexed)), documents.text_of(F.unhex(hexed))])

cases("section_points", "title place total", "score", [
    ("Nævnets bemærkninger og afgørelse", 1, 3, 142.0), ("Klagerens synspunkter", 0, 3, -100.0), ("Nævnets vurdering", 2, 3, 130.0), ("Afgørelse", 0, 2, 44.0), ("Andet", 1, 2, 0.0), ("Bemærkninger", 1, 1, 15.0),
], lambda title, place, total: [_points(title, place, total)])


def _points(title, place, total):
    @F.pandas_udf("double")
    def run(t, p, n):
        import pandas as pd

        return pd.Series([reasoning.section_score(a, int(b), int(c)) for a, b, c in zip(t, p, n, strict=True)])

    return run(title, place, total)


cases("paragraph_points", "said place total", "score", [
    ("Nævnet finder derfor, at taget var utæt.", 0, 2, 13.0), ("Klageren var bekendt med fristen.", 1, 2, 10.0), ("Intet", 0, 1, 0.0), ("Selskabet skal betale. Nævnet bemærker: ikke godtgjort.", 2, 3, 19.0),
], lambda said, place, total: [_worth(said, place, total)])


def _worth(said, place, total):
    @F.pandas_udf("double")
    def run(t, p, n):
        import pandas as pd

        return pd.Series([reasoning.paragraph_score(a, int(b), int(c)) for a, b, c in zip(t, p, n, strict=True)])

    return run(said, place, total)


_TEXTS = ("Indledning her er lang nok.\n\n## Vurdering\nNævnet finder, at taget er utæt.\nDerfor dækkes skaden.\n\nKort.", "KONKLUSION:\nKlagen tages ikke til følge.\n\nKlagen tages ikke til følge.")


@query("""WITH made(i, section, section_title, paragraph, text, "begin", "end") AS (VALUES (0, 0, 'Kendelse', 0, 'Indledning her er lang nok.', 0, 27), (0, 1, 'Vurdering', 0, 'Nævnet finder, at taget er utæt. Derfor dækkes skaden.', 27, 81),
    (1, 0, 'KONKLUSION:', 0, 'Klagen tages ikke til følge.', 12, 40), (1, 0, 'KONKLUSION:', 1, 'Klagen tages ikke til følge.', 42, 70))
    SELECT doc_id, section, section_title, paragraph, made.text AS text, "begin", "end", 'par-' || substr(sha1(doc_id || chr(31) || section || chr(31) || paragraph || chr(31) || made.text), 1, 12) AS paragraph_id FROM documents JOIN made ON doc_id % 2 = i""")
def paragraph_places(spark, sf_dir):
    """Paragraphs of texts dealt to documents, with their places."""
    i = F.col("doc_id") % 2
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, _TEXTS[0]).otherwise(_TEXTS[1]).alias("text"))
    return passages.paragraphs(docs)
