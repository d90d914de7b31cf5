"""Classifiers of the planning and environment boards' decisions and of scraped ones, as Columns.

Rules are data, (label, pattern for Java's regex) in order; all look at lower-cased text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.matches import any_of, last_place
from docketry.functions.rules import Rules, all_labels, first_label
from docketry.functions.text import strip_html

# Outcomes of the planning board, by title, by conclusion, by the whole text.
PLANNING_TITLE: Rules = (
    ("Orientering", "planklagenævnet orienterer"),
    ("Afvist", "afslag på gen[p]?tagelse"),
    ("Afvist", "afslag på opsættende virkning"),
    ("Medhold", "meddelelse af opsættende virkning"),
    ("Ophævet", "ophævet|ugyldig|annulleret|hjemvisning|hjemvises|hjemvist|delvist ophæv|ændret af nævnet"),
    ("Medhold", "medhold"),
    ("Ikke medhold", "stadfæst"),
    ("Afvist", "afvisning|afvises|afvist"),
)
PLANNING_CONCLUSION: Rules = (
    ("Ophævet", "ophæver|hjemviser|hjemvisning|ugyldiggør|ophæves|hjemvises|ændrer den påklagede|ændres hermed|påklagede afgørelse ændres"),
    ("Ikke medhold", "kan ikke give medhold|ikke medhold|stadfæst|ikke grundlag for at ændre|ingen anledning til at ændre|ikke anledning til at|nævnet finder ikke grundlag|klagen ikke tages til følge|tages ikke til følge"),
    ("Afvist", "afviser klagen|afvises som|afviser hermed|klagen afvises"),
    ("Medhold", "medhold|tager klagen til følge|klagen tages til følge"),
)
PLANNING_TEXT: Rules = (
    ("Medhold", "klagen tages til følge|giver klageren medhold|nævnet giver medhold"),
    ("Ikke medhold", "klagen tages ikke til følge|nævnet stadfæster|stadfæstes hermed|ikke grundlag for at"),
    ("Ophævet", "nævnet ophæver|ophæves hermed|nævnet hjemviser|hjemvises hermed"),
    ("Afvist", "klagen afvises|afvises som åbenbart|afvises som for sent"),
)
# Kinds of plans, documents, and groups of cases.
PLAN_TYPES: Rules = (("Kommuneplantillæg", "kommuneplantillæg"), ("Kommuneplan", "kommuneplan(?!tillæg)"), ("Lokalplan", "lokalplan"))
DOCUMENT_TYPES: Rules = (("Screeningsafgørelse", "screeningsafgørelse|screeningen"), ("Miljørapport", r"(?U)miljørapport|miljøvurdering|\bvvm\b"))
CASE_GROUPS: Rules = (("Genoptagelse", "genoptagelse"), ("Opsættende virkning", "opsættende virkning|afslag på opsættende"), ("Afvisning", "afvisning|afvises|klageberettiget"))
PLAN = "lokalplan|kommuneplantillæg|kommuneplan|byplanvedtægt"
ADOPTED = rf"(?U)vedtagelse af\b.{{0,80}}?({PLAN})"
# Outcomes, kinds of cases and sub-categories of the environment board, by title.
ENVIRONMENT_TITLE: Rules = (
    ("Hjemvist", "hjemvisning|hjemvises|hjemvist"),
    ("Ophævet", "ophaevelse|ophævelse|ophævet|ophæves"),
    ("Ændring", "aendring|ændring|ændres"),
    ("Stadfæstelse", "ikke medhold"),
    ("Afvist", "afvisning|afvises|afvist|klagefristen overskredet"),
    ("Stadfæstelse", "stadfaestelse|stadfæstes|stadfæstelse"),
    ("Afslag", "afslag"),
)
ENVIRONMENT_CASES: Rules = (
    ("Genoptagelse", "genoptagelse"), ("Opsættende virkning", "opsaettende virkning|opsættende virkning"), ("Afvisning", "afvisning|afvises"), ("Registrering", "registrering"),
    ("Dispensation", "dispensation"), ("Lovliggørelse", "lovliggoerelse|lovliggørelse"), ("Godkendelse", "godkendelse"), ("Tilladelse", "tilladelse"), ("Anmeldelse", "anmeldelse"),
    ("Vedtagelse", "vedtagelse"), ("Påbud", "paabud|påbud"), ("Forbud", "forbud"), ("Aktindsigt", "aktindsigt"),
)
PROTECTION_LINES: Rules = (
    ("Strandbeskyttelseslinje", "strandbeskyttelseslinje|havstokken"), ("Fortidsmindebeskyttelseslinje", "fortidsmindebeskyttelseslinje"), ("Åbeskyttelseslinje", "aabeskyttelseslinje|åbeskyttelseslinje"),
    ("Søbeskyttelseslinje", "soebeskyttelseslinje|søbeskyttelseslinje"), ("Skovbyggelinje", "skovbyggelinje"), ("Klitfredning", "klitfredning"), ("Kirkebeskyttelseslinje", "kirkebeskyttelseslinje"),
)
NATURE_TYPES: Rules = (
    ("Strandeng", "strandeng"), ("Eng", "eng"), ("Hede", "hede"), ("Mose", "mose"), ("Overdrev", "overdrev"), ("Vandløb", "vandloeb|vandløb"), ("Skov", "skov"), ("Sø", "soe|sø"), ("Klitter", "klit"),
)
# Outcomes of scraped rulings, by the kind of ruling and by the end of the text; kinds of defects by parts of words.
RULING_TYPES: Rules = (("Delvis medhold", "delvis"), ("Medhold", "klager medhold"), ("Ikke medhold", "selskab medhold"), ("Afvist", "afvis"))
RULING_ENDS: Rules = (
    ("Ikke medhold", "klageren får ikke medhold|klagerens påstand tages ikke til følge|selskabet frifindes|selskab medhold"),
    ("Delvis medhold", "delvist medhold|delvis medhold"),
    ("Medhold", "klageren får medhold|klagerens påstand tages til følge|den indklagede tilpligtes|selskabet skal anerkende"),
    ("Afvist", "klagen afvises|afvises som"),
)
DEFECT_PARTS: Rules = (
    ("Skimmel/fugt", "skimmel|fugt"), ("Tag/tagdækning", "tag"), ("Kloak/dræn", "kloak|dræn|afløb|spildevand|faldstamme"),
    ("Installationer", "el-install|el install|vand-install|varmeinstal|installationsskade|stikledning"), ("Fundament", "fundament|sokkel|sætningsskade"), ("Vinduer/døre", "vindue|døre"),
    ("Murværk/facade", "murværk|mursten|facade|puds"), ("Råd/svamp/insekt", "råd|trænedbrydende|svamp|insektangreb|borebille"),
    ("Konstruktion/bærende", "bjælke|bærende konstruktion|spær|trækonstruktion|etageadskillelse"), ("Badeværelse/vådrum", "badeværelse|vådrum"), ("Gulv", "gulv"),
)


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _or(labels: Column, default: str) -> Column:
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(default)))


def planning_outcome(title: Column, text: Column) -> Column:
    """By the title, else by the 800 characters from the last closing remarks on (without any the last 1200), else by the text."""
    said = F.lower(strip_html(text))
    closing = last_place(said, "afsluttende bem[æa]rkninger")
    end = F.when(closing.isNotNull(), F.substring(said, closing + 1, F.lit(800))).otherwise(F.right(said, F.lit(1200)))
    return F.coalesce(first_label(_low(title), PLANNING_TITLE), first_label(end, PLANNING_CONCLUSION), first_label(said, PLANNING_TEXT), F.lit("Ukendt"))


def plan_types(title: Column) -> Column:
    return _or(all_labels(_low(title), PLAN_TYPES), "Andet")


def planning_categories(title: Column) -> Column:
    """A plan's adoption with what comes along, else the first theme that the title shows."""
    t = _low(title)
    plan, screened, assessed = t.rlike(PLAN), F.contains(t, F.lit("screeningsafgørelse")), any_of(t, ("miljørapport", "miljøvurdering", "vvm"))
    exempt, conforms = F.contains(t, F.lit("dispensation")), F.contains(t, F.lit("overensstemmelse"))
    along = F.when(screened, F.lit("Miljøvurderingsloven")), F.when(assessed, F.lit("Miljøvurderingsloven"))
    adopted = F.array_compact(F.array(F.when(exempt, F.lit("Dispensation")).when(conforms, F.lit("Overensstemmelse")).otherwise(F.lit("Planvedtagelse")), *along))
    theme = (
        F.when(t.rlike(r"(?U)screeningsafgørelse|screeningen|miljøvurdering|miljørapport|\bvvm\b"), "Miljøvurderingsloven")
        .when(exempt & (plan | t.rlike("planlovens|planlov|servitut")), "Dispensation").when(conforms & plan, "Overensstemmelse").when(F.contains(t, F.lit("endelig vedtagelse")) & plan, "Planvedtagelse")
        .when(plan, "Andet").when(F.contains(t, F.lit("landzone")), "Landzone").otherwise("Andet")
    )
    return F.when(t.rlike(ADOPTED), adopted).otherwise(F.array(theme))


def document_type(title: Column) -> Column:
    return first_label(_low(title), DOCUMENT_TYPES)


def case_group(title: Column, text: Column) -> Column:
    return first_label(F.concat(_low(title), F.lit(" "), F.substring(_low(text), 1, 500)), CASE_GROUPS, "Realitetsbehandling")


def environment_outcome(title: Column) -> Column:
    return first_label(_low(title), ENVIRONMENT_TITLE, "Ukendt")


def environment_case(title: Column) -> Column:
    return first_label(_low(title), ENVIRONMENT_CASES, "Realitetsbehandling")


def protection_line(title: Column, text: Column) -> Column:
    return first_label(F.concat(_low(title), F.lit(" "), F.substring(_low(text), 1, 400)), PROTECTION_LINES, "Andet")


def nature_type(title: Column) -> Column:
    return first_label(_low(title), NATURE_TYPES, "Andet")


def ruling_outcome(text: Column, kind: Column) -> Column:
    """By the kind of ruling, else by the last 3000 characters."""
    return F.coalesce(first_label(_low(kind), RULING_TYPES), first_label(F.right(_low(text), F.lit(3000)), RULING_ENDS), F.lit("Ukendt"))


def defect_parts(text: Column) -> Column:
    return _or(all_labels(_low(text), DEFECT_PARTS), "Andet")


def municipality(title: Column) -> Column:
    """The name before "Kommune"; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), r"([A-ZÆØÅ][a-zæøå]+-?[A-ZÆØÅ]?[a-zæøå]*)\s+Kommunes?", 1), F.lit(""))


def file_names(category: Column) -> tuple[Column, Column]:
    """Names of a category's file: with the Danish letters spelled out before other characters go, and after."""

    def spelled(x: Column) -> Column:
        for a, b in (("æ", "ae"), ("ø", "oe"), ("å", "aa")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    def bare(x: Column, kept: str) -> Column:
        return F.regexp_replace(F.regexp_replace(x, f"[^{kept}]+", "_"), "^_+|_+$", "")

    low = F.lower(category)
    return F.concat(F.lit("mfkn_"), bare(spelled(F.replace(low, F.lit("–"), F.lit("-"))), "a-z0-9"), F.lit(".csv")), F.concat(F.lit("pkn_"), spelled(bare(low, "a-z0-9æøå")), F.lit(".csv"))
