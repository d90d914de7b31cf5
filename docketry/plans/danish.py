"""Rules over Danish texts. The driver's texts hardly meet them, so each document is dealt one of a query's cases by its id:
inputs for the Spark side, and for the SQL what the rules make of them, worked out by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import boards, danish, rules
from docketry.functions import lexicon_da as lex
from docketry.operators import reasoning
from docketry.plans.registry import ORACLES, QUERIES, table


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value}::DOUBLE"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def cases(name: str, takes: str, gives: str, rows: list[tuple], f: Callable[..., list[Column]]) -> None:
    """Registers a query: rows hold inputs, then results; names of either are space-separated."""
    inputs, results = takes.split(), gives.split()
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}

    def run(spark, sf_dir):
        kind = lambda k: kinds[next((type(r[k]) for r in rows if r[k] is not None), str)]
        schema = ", ".join(["i long", *(f"{n} {kind(k)}" for k, n in enumerate(inputs))])
        given = spark.createDataFrame([(i, *r[: len(inputs)]) for i, r in enumerate(rows)], schema)
        docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(rows))).cast("long").alias("i"))
        made = f(*(F.col(n) for n in inputs))
        return docs.join(F.broadcast(given), "i").select("doc_id", *(c.alias(n) for c, n in zip(made, results, strict=True)))

    run.__name__, run.__doc__ = name, f"{gives} of a case of {takes} for each document."
    values = ", ".join(f"({i}, {', '.join(_sql(v) for v in r[len(inputs) :])})" for i, r in enumerate(rows))
    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, {', '.join(results)} FROM documents JOIN (VALUES {values}) AS told(i, {', '.join(results)}) ON doc_id % {len(rows)} = i"


def joined(x: Column) -> Column:
    return F.array_join(x, ";")


cases("defect_kinds", "title said", "kinds", [
    ("Skimmel på loftet", "", "Skimmel/fugt;Konstruktion/bærende"), ("Utæt tag og inddækning", "", "Tag/tagdækning"), ("Kloakken er tilstoppet", "", "Kloak/dræn"), ("Defekt varmepumpe", "", "Installationer"),
    ("Revner i fundamentet", "", "Fundament"), ("Punkteret termorude", "", "Vinduer/døre"), ("Løse mursten og murbinder", "", "Murværk/facade"), ("Råd og husbukke", "", "Råd/svamp/insekt"),
    ("Ægte hussvamp", "", "Råd/svamp/insekt"), ("Skimmelsvamp", "", "Skimmel/fugt"), ("Fejl ved bærende bjælke", "", "Konstruktion/bærende"), ("Vådrum uden membran", "", "Badeværelse/vådrum"),
    ("Knirkende trægulve", "", "Gulv"), ("Ulovlig tilbygning", "", "Ulovlige forhold"), ("Sag nr. 7", "Gulvet hælder, og der er fugt i kælderen.", "Skimmel/fugt;Fundament;Gulv"), ("Sag nr. 8", "Intet.", "Andet"), (None, None, "Andet"),
], lambda title, said: [joined(rules.defects(title, said))])

cases("defect_parts", "said", "kinds", [
    ("Der er fugt.", "Skimmel/fugt"), ("Sagen blev taget op", "Tag/tagdækning"), ("Afløb og faldstamme", "Kloak/dræn"), ("El-installationer", "Installationer"), ("Sokkel", "Fundament"), ("To vinduer", "Vinduer/døre"),
    ("Facade af puds", "Murværk/facade"), ("Svamp i spær", "Råd/svamp/insekt;Konstruktion/bærende"), ("Badeværelse med gulv", "Badeværelse/vådrum;Gulv"), ("Intet", "Andet"), (None, "Andet"),
], lambda said: [joined(boards.defect_parts(said))])

cases("ruling_outcomes", "said kind", "outcome", [
    ("", "Klager delvist medhold", "Delvis medhold"), ("", "Klager medhold", "Medhold"), ("", "Selskab medhold", "Ikke medhold"), ("", "Sagen afvist", "Afvist"), ("Klageren får ikke medhold.", "", "Ikke medhold"),
    ("Klageren får delvis medhold.", None, "Delvis medhold"), ("Selskabet skal anerkende kravet.", "Principielle afgørelser", "Medhold"), ("Klagen afvises.", "", "Afvist"), ("Uden ord herom.", "", "Ukendt"), (None, None, "Ukendt"),
], lambda said, kind: [boards.ruling_outcome(said, kind)])

cases("planning_outcomes", "title said", "outcome grp", [
    ("Planklagenævnet orienterer om praksis", "", "Orientering", "Realitetsbehandling"), ("Afslag på genptagelse af sag", "", "Afvist", "Realitetsbehandling"), ("Afslag på opsættende virkning", "", "Afvist", "Opsættende virkning"),
    ("Meddelelse af opsættende virkning", "", "Medhold", "Opsættende virkning"), ("Ophævelse og hjemvisning af dispensation", "", "Ophævet", "Realitetsbehandling"), ("Stadfæstelse af lokalplan", "", "Ikke medhold", "Realitetsbehandling"),
    ("Afvisning af klage", "", "Afvist", "Afvisning"), ("Sag om lokalplan", "Nævnet ophæver. Afsluttende bemærkninger: Nævnet kan ikke give medhold i klagen.", "Ikke medhold", "Realitetsbehandling"),
    ("Sag om lokalplan", "<p>Afsluttende bemærkninger</p> Nævnet <b>ophæver</b> afgørelsen", "Ophævet", "Realitetsbehandling"), ("Sag om genoptagelse", "Klagen tages til følge.", "Medhold", "Genoptagelse"), (None, None, "Ukendt", "Realitetsbehandling"),
], lambda title, said: [boards.planning_outcome(title, said), boards.case_group(title, said)])

cases("planning_categories", "title", "categories plans document municipality", [
    ("Vedtagelse af lokalplan 12 i Odense Kommune med screeningsafgørelse", "Planvedtagelse;Miljøvurderingsloven", "Lokalplan", "Screeningsafgørelse", "Odense"),
    ("Dispensation ved vedtagelse af kommuneplantillæg og miljørapport", "Dispensation;Miljøvurderingsloven", "Kommuneplantillæg", "Miljørapport", None),
    ("Screeningen af et vindmølleprojekt", "Miljøvurderingsloven", "Andet", "Screeningsafgørelse", None), ("Dispensation fra byplanvedtægt", "Dispensation", "Andet", None, None),
    ("Overensstemmelse med kommuneplan", "Overensstemmelse", "Kommuneplan", None, None), ("Endelig vedtagelse efter høring om byplanvedtægt", "Planvedtagelse", "Andet", None, None),
    ("Landzonetilladelse i Lyngby-Taarbæk Kommunes område", "Landzone", "Andet", None, "Lyngby-Taarbæk"), ("VVM-pligt", "Miljøvurderingsloven", "Andet", "Miljørapport", None), ("Lokalplan for centeret", "Andet", "Lokalplan", None, None), (None, "Andet", "Andet", None, None),
], lambda title: [joined(boards.planning_categories(title)), joined(boards.plan_types(title)), boards.document_type(title), boards.municipality(title)])

cases("environment_cases", "title said", "outcome kind line nature", [
    ("Hjemvisning af sag om dispensation", "", "Hjemvist", "Dispensation", "Andet", "Andet"), ("Ophævelse af tilladelse ved strandeng", "strandbeskyttelseslinje", "Ophævet", "Tilladelse", "Strandbeskyttelseslinje", "Strandeng"),
    ("Ændring af påbud om hede", "", "Ændring", "Påbud", "Andet", "Hede"), ("Ikke medhold i klage over forbud", "skovbyggelinje", "Stadfæstelse", "Forbud", "Skovbyggelinje", "Andet"),
    ("Klagefristen overskredet, mose", "", "Afvist", "Realitetsbehandling", "Andet", "Mose"), ("Stadfæstelse af registrering af vandløb", "", "Stadfæstelse", "Registrering", "Andet", "Vandløb"),
    ("Afslag på godkendelse ved søen", "søbeskyttelseslinje", "Afslag", "Godkendelse", "Søbeskyttelseslinje", "Sø"), ("Aktindsigt", "klitfredning", "Ukendt", "Aktindsigt", "Klitfredning", "Andet"),
], lambda title, said: [boards.environment_outcome(title), boards.environment_case(title), boards.protection_line(title, said), boards.nature_type(title)])

cases("category_files", "category", "one other", [
    ("Råstoffer – øvrige sager", "mfkn_raastoffer_oevrige_sager.csv", "pkn_raastoffer_oevrige_sager.csv"), ("Natur/Miljø", "mfkn_natur_miljoe.csv", "pkn_natur_miljoe.csv"), ("  Æ & Å ", "mfkn_ae_aa.csv", "pkn_ae_aa.csv"),
], lambda category: list(boards.file_names(category)))

cases("law_and_year_mentions", "said", "laws years", [
    ("huset opført 1930 og taget fra 1960", "", "1930;1960"), ("FAL og lov nr. 12, jf. forsikringsaftaleloven", "forsikringsaftaleloven;lov nr. 12", ""), ("efter forsikringsaftalelovens regler", "", ""),
    ("Bekendtgørelse nr. 9a samt lov  nr 606 og lov nr. 606", "bekendtgørelse nr. 9a;lov nr 606;lov nr. 606", ""), ("Byggeår: 1972. Gulvet er fra 1999; vinduerne stammer fra 2003.", "", "1972;1999;2003"),
    ("Lov om forbrugerbeskyttelse ved erhvervelse af fast ejendom, bygget i 1899", "lov om forbrugerbeskyttelse ved erhvervelse af fast ejendom", "1899"), (None, "", ""),
], lambda said: [joined(lex.laws(said)), joined(F.transform(lex.years(said), lambda y: y.cast("string")))])

cases("cover_levels", "title said", "cover", [
    ("", "Klageren har tegnet udvidet ejerskifteforsikring.", "Udvidet"), ("", "Køberen havde tegnet en 5-årig basis ejerskift eforsikri ng.", "Basis"), ("", "Ejerskifteforsikringen (police) med udvidet dækning gælder.", "Udvidet"),
    ("", "Forsikringen er tegnet som en standard.", "Basis"), ("", "Der blev tegnet forsikringen med ekstrasikring.", "Udvidet"), ("", "Der blev ikke tegnet udvidet dækning.", "Basis"), ("", "Sagen er omfattet af den udvidede dækning.", "Udvidet"),
    ("", "Klageren har tegnet udvidet ejerskifteforsikring. Nævnet udtaler: Klageren har tegnet basis ejerskifteforsikring.", "Basis"), ("Med udvidet dækning", "Intet.", "Udvidet"), (None, None, "Ikke angivet"),
], lambda title, said: [reasoning.cover_of(said, title)])

cases("query_intents", "said", "kind confidence retrieve final hyde lexical", [
    ("Vis sag nr. 12345/2", "specific", 0.99, 80, 10, False, True), ("se ankeforsikring.dk/sag1.", "specific", 0.99, 80, 10, False, True), ("Hvor står \"ordret gengivet tekst\"", "exact", 0.95, 120, 20, False, True),
    ("tekster som indeholder fugt", "exact", 0.95, 120, 20, False, True), ("find afgørelser med skimmel", "exact", 0.86, 120, 20, False, True), ("Er forholdet dækket i min sag", "case", 0.93, 100, 15, True, False),
    ("Vi købte et hus i foråret og så kort efter at der var fugt i hele kælderen og vi har derfor anmeldt den slags", "case", 0.76, 100, 15, True, False),
    ("Hvad er praksis typisk", "practice", 0.88, 120, 18, True, False), ("Hvad betyder selvrisiko", "factual", 0.84, 60, 8, False, False), ("Og så?", "factual", 0.62, 60, 8, False, False), ("tagrender", "exploratory", 0.55, 100, 15, True, False), (None, "exploratory", 0.55, 100, 15, True, False),
], lambda said: (lambda x: [x["intent"], x["confidence"], x["retrieve"], x["final"], x["hyde"], x["lexical"]])(danish.intent(said)))

cases("query_plans", "said", "added matched reason", [
    ("opbulnet parket", "parketgulv;trægulv;gulv;opbulning;hævet gulv;deformation", "parketgulv;gulvdeformation", None), ("fugt", "fugtskade;opfugtning;vandindtrængning", "fugt", None), ("utæt og fugt", "fugtskade;opfugtning;vandindtrængning;utæthed", "fugt;utæthed", None),
    ("kosmetisk æstetisk", "", "kosmetisk", "no_missing_terms"), ("hævet-gulv", "opbulning;deformation", "gulvdeformation", None), ("", "", "", "empty_query"), ("tagsten", "", "", "no_known_concepts"), ("\"fugt\" ordret", "", "", "precision_sensitive_intent"),
    ("fugt i kælder og på loft", "", "", "informative_query_preserved"), ("slid levetid udtjent", "restlevetid;udløbet levetid;forventet levetid;slitage;slid og ælde;sædvanligt slid", "levetid;slid", None),
    ("fugt slid råd udskiftning", "fugtskade;opfugtning;vandindtrængning;rådskade;rådskadet;slitage;slid og ælde;sædvanligt slid;udskiftet;fornyelse", "fugt;råd;slid;udskiftning", None),
], lambda said: (lambda x: [joined(x["added"]), joined(x["matched"]), x["reason"]])(danish.query_plan(said)))

cases("board_terms", "said", "more", [
    ("rodindvækst i kloak", "rodindvækst i kloak rødder"), ("Rodvækst og rødder", "Rodvækst og rødder"), ("rodindtrængning, rodvækst", "rodindtrængning, rodvækst rødder"), ("tag", "tag"), (None, None),
], lambda said: [danish.expanded(said)])

cases("sub_question_split", "said", "parts", [
    ("Er skader på taget dækket, når taget er udtjent ved overtagelsen? Og hvilken betydning har det, at tilstandsrapporten ikke nævner taget med et eneste ord?",
     "Er skader på taget dækket, når taget er udtjent ved overtagelsen?;Og hvilken betydning har det, at tilstandsrapporten ikke nævner taget med et eneste ord?"),
    ("Kort spørgsmål? Og et til, som også er kort?", ""),
    ("Vi har fundet skimmelsvamp bag panelerne i hele kælderen efter en vandskade – hvad siger praksis om følgeskader efter overtagelsen; og hvem bærer risikoen for dem",
     "Vi har fundet skimmelsvamp bag panelerne i hele kælderen efter en vandskade?;hvad siger praksis om følgeskader efter overtagelsen?;hvem bærer risikoen for dem?"), (None, ""),
], lambda said: [joined(danish.sub_questions(said))])

cases("guideline_citations", "said", "found", [
    ("Se vejledning om støj fra vindmøller, side 4.", "Støj fra vindmøller"), ("Vejledning nr. 9725 af 5. juli 2005 gælder.", "Vejledning nr. 9725 af 5. juli 2005"), ("Naturstyrelsens vejledning om beskyttede arter er klar", "Naturstyrelsens vejledning om beskyttede arter er klar"),
    ("Planlægningsvejledningen og vejl. om lugt fra stalde (2002)", "Planlægningsvejledningen;Lugt fra stalde"), ("vejledning om lovgivning, her", ""), ("vejledning om støj.", ""), (None, ""),
], lambda said: [joined(danish.guideline_references(said))])

cases("decision_identifiers", "said", "found", [
    ("Se sag nr. 12.345, kendelse 99/123 og afgørelse: A-1000.", "12.345;99/123;A-1000"), ("ankenaevnet.dk/sag/7) og sagsnummer 4711", "4711;ankenaevnet.dk/sag/7"), ("Sag 77", ""), (None, ""),
], lambda said: [joined(danish.identifiers(said))])

cases("ground_contrast", "core excerpt one other", "grounds exclusive score priority", [
    ("Tilstandsrapporten nævner slid og ælde.", "Taget er udtjent.", "Vurdering", "vurdering ", "condition_report;wear_or_lifetime", "condition_report", 2.0, "medium"),
    ("Ikke godtgjort, anmeldt efter fristen på 5.000 dage", "", "A", "B", "takeover_proof;deadline_or_limitation;amount_threshold", "takeover_proof;deadline_or_limitation;amount_threshold", 6.5, "high"),
    ("Intet her", "Kendt forhold", "A", "a", "", "", 0.0, "low"),
    ("Undtagelse i vilkår; efterfølgende lovkrav og manglende vedligeholdelse, klager var bekendt med bevisførelse", "lovkrav", "A", "B", "known_condition;coverage_exclusion;maintenance;post_takeover_cause;procedural;legal_compliance_only", "known_condition;coverage_exclusion;maintenance;post_takeover_cause;procedural", 10.5, "high"),
], lambda core, excerpt, one, other: (lambda x: [joined(danish.grounds(core)), joined(x["exclusive"]), x["score"], x["priority"]])(danish.contrast(core, excerpt, one, other)))

cases("ruling_dates", "said", "day", [
    ("Den 29. maj 2006 blev i sag nr. 66.295", "2006-05-29"), ("København, den 12. DECEMBER 2018. 1. jan 2019", "2018-12-12"), ("5. okt 1999", "1999-10-05"), ("31. februar 2010", None), ("12-12-2018", None), (None, None),
], lambda said: [F.date_format(danish.ruling_date(said), "yyyy-MM-dd")])

cases("axis_maxima", "v", "top", [(0, 5.0), (5, 5.0), (6, 10.0), (11, 20.0), (24, 25.0), (26, 50.0), (99, 100.0), (101, 200.0), (249, 250.0), (1000, 1000.0), (6001, 10000.0)], lambda v: [danish.nice_maximum(v.cast("double"))])

cases("facts_without_outcome", "title said", "facts", [
    ("Klager over tag. Selskab medhold.", "Taget er fra 1960. Nævnet finder intet. Det er utæt.", "Klager over tag.\n\nTaget er fra 1960. Det er utæt."), ("Fugt", "Kælderen er våd. Kravet blev afvist.", "Fugt\n\nKælderen er våd."), (None, None, "\n\n"),
], lambda title, said: [danish.facts_only(title, said)])

cases("relabelled_sources", "said", "shown", [
    ("Se [Kilde 1] og [Kilde 2, 3].", "Se [A 2001] og [B 2002]."), ("Kun [Kilde 9].", "Kun [Kilde 9]."), ("[Kilde 2][Kilde 1]", "[B 2002][A 2001]"), ("Ingen", "Ingen"), (None, ""),
], lambda said: [danish.relabelled(said, F.array(F.lit("A 2001"), F.lit("B 2002")))])

cases("audit_verdicts", "said", "verdict", [("Understøttet ", "understøttet"), ("delvis", "delvist"), ("ikke understøttet", "ikke_understøttet"), ("modsagt", "modsagt"), ("ved ikke", "ikke_understøttet"), (None, "ikke_understøttet")], lambda said: [danish.verdict(said)])

cases("title_headlines", "title", "headline rest", [
    ("Klager over afslag på dækning for utæt tag. Selskab medhold.", "Utæt tag", "Selskab medhold."), ("Ejerskifte - klageren klager over fugt i kælder bl.a. Odense. Klager medhold.", "Fugt i kælder bl.a. Odense", "Klager medhold."), ("Kort titel.", "Kort titel", ""), (None, "", ""),
], lambda title: (lambda x: [x["headline"], x["rest"]])(danish.headlines(title)))

cases("highlights", "said query", "html", [
    ("Fugt & skimmel i tag", "tag fugt", "<mark>Fugt</mark> &amp; skimmel i <mark>tag</mark>"), ("tagtag tag", "tag og", "<mark>tag</mark><mark>tag</mark> <mark>tag</mark>"), ("aaa aaa", "xx", "aaa aaa"), ("mark mark", "mark", "<mark>mark</mark> <mark>mark</mark>"), (None, None, ""),
], lambda said, query: [danish.highlighted(said, query)])

cases("reading_texts", "said", "paragraphs", [
    ("Ankenævnet\nK e n d e l s e :\nKlageren ejer et\nhus fra 1930. Det er\nutæt.\nSelskabet afviste.", "Klageren ejer et hus fra 1930. Det er utæt.|Selskabet afviste."), ("Første del-\ntekst\n____\n## Afsnit\nNyt her", "Første deltekst|## Afsnit|Nyt her"),
    ("Bestemmes:\nSelskabet skal betale", "Bestemmes:|Selskabet skal betale"), (None, ""),
], lambda said: [F.array_join(danish.reading_text(said), "|")])

cases("board_part_offsets", "said", "part assessment", [
    ("Klager skriver. Nævnet udtaler: Sagen drejer sig om tag. Nævnet finder, at taget er utæt.", 16, 56), ("Ingen markør her.", None, None), ("Nævnet udtaler: Selskabet har anført A. Klageren har anført B. Taget er utæt.", 0, 62), (None, None, None),
], lambda said: (lambda x: [x["part"], x["assessment"]])(reasoning.board_parts_of(said)))

cases("outcome_conflicts", "said", "found", [
    ("I [Kilde 1] fik klageren medhold.", "1:Medhold:Ikke medhold"), ("[Kilde 1] (medhold) og [Kilde 2]: ikke medhold", "1:Medhold:Ikke medhold;2:Ikke medhold:Medhold"), ("Blandt 10 kendelser fik klageren medhold [Kilde 1].", ""),
    ("Klageren fik ikke medhold [Kilde 2], men selskabet fik medhold [Kilde 1].", "2:Ikke medhold:Medhold"), ("Klageren fik helt eller delvist medhold [Kilde 1].", "1:Medhold:Ikke medhold"), ("Klageren fik delvist medhold [Kilde 1-2]; køberen fik medhold [Kilde 2].", "1:Delvis medhold:Ikke medhold;2:Delvis medhold:Medhold"), (None, ""),
], lambda said: [joined(F.transform(reasoning.conflicts_of(said, F.array(F.lit("Ikke medhold"), F.lit("Medhold"))), lambda x: F.concat_ws(":", x["source"].cast("string"), x["said"], x["true"])))])

cases("answer_checks", "said", "chars citations invalid cites_cases", [
    ("Se [Kilde 1, 3-5] og [Kilde 9].", 31, 5, "9", False), ("Sag 12345 uden kilder", 21, 0, "", True), ("[Kilder 0-2]", 12, 3, "0", False), (None, 0, 0, "", False),
], lambda said: (lambda x: [x["chars"], x["citations"], joined(F.transform(x["invalid"], lambda n: n.cast("string"))), x["cites_cases"]])(danish.answer_checks(said, F.lit(5))))

cases("source_tags", "day estimated outcome", "tags", [
    ("2006-05-29", False, "Medhold", "[Afsagt: 29.05.2006] [Udfald for klager: Medhold]"), ("2006-05-29", True, "Ukendt", "[Afsagt: ca. 29.05.2006]"), (None, False, "Afvist", "[Udfald for klager: Afvist]"), (None, False, None, ""),
], lambda day, estimated, outcome: [danish.source_tags(F.to_date(day), estimated, outcome)])

_RULING = (
    "## Klagerens synspunkter\nKlageren har anført, at taget er utæt og skal dækkes af selskabet.\n\n## Nævnets bemærkninger og afgørelse\nIndledende om sagen og dens forløb gennem årene.\n\n"
    "Taget var utæt ved overtagelsen, og undertaget var revnet flere steder.\n\nSelskabet skal derfor anerkende dækning for taget.\n\nSelskabet skal betale sagens omkostninger.\n\nFor vinduet finder nævnet intet."
)
cases("decision_core_selection", "said query", "section core fallback", [
    (_RULING, "utæt undertag", "Nævnets bemærkninger og afgørelse", "Taget var utæt ved overtagelsen, og undertaget var revnet flere steder.\n\nSelskabet skal derfor anerkende dækning for taget.\n\nSelskabet skal betale sagens omkostninger.", False),
    (_RULING, "vinduet", "Nævnets bemærkninger og afgørelse", "For vinduet finder nævnet intet.", False), ("Kun en kort tekst uden afsnit.", "tag", "Kendelse", "Kun en kort tekst uden afsnit.", True), (None, "tag", "", "", True),
], lambda said, query: (lambda x: [x["section"], x["text"], x["fallback"]])(reasoning.cores_of(said, query)))
