"""Ordered rules as Columns: the first that matches, or all that do. Rules are data: (label, pattern for Java's regex)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = tuple[tuple[str, str], ...]

# Outcome rules for the last sentence of a title and for a conclusion, in order.
_M = "me?d?hold"
TITLE_OUTCOMES: Rules = (
    ("Delvis medhold", rf"(?U)\bdelvis(?:t|e)?\s+{_M}\b"),
    ("Medhold", rf"(?U)(?<!ikke give )\bklager(?:en|ne)?\s+{_M}\b"),
    ("Ikke medhold", rf"(?U)\bselskab(?:et)?\s+{_M}\b"),
    ("Afvist", r"(?U)\bsag(?:en)?\s+afvist|\bafvisning\b|\bklagen\s+afvis|(?:kunne|kan)\s+(?:derfor\s+)?ikke\s+(?:afgøre|behandle|viderebehandle)\s+sagen|afstå\s+fra\s+at\s+(?:vide)?(?:re)?behandle|afvise\s+(?:at\s+afgøre\s+)?sagen"),
)
TEXT_OUTCOMES: Rules = (
    ("Afvist", r"(?U)nævnet\s+kan\s+ikke\s+(?:afgøre|behandle|viderebehandle)\s+sagen|klagen\s+afvises|afvises\s+som\s+åbenbart|kan\s+ikke\s+realitetsbehandles"),
    ("Delvis medhold", r"(?U)i\s+øvrigt\s+ikke\s+medhold|delvis(?:t)?\s+medhold|i\s+øvrigt\s+ikke\s+tages\s+til\s+følge"),
    ("Ikke medhold", r"(?U)ikke\s+tages\s+til\s+følge|får\s+ikke\s+medhold|selskabet\s+frifindes|tilpligtes\s+ikke"),
    ("Medhold", r"(?U)klageren\s+får\s+medhold|tages\s+til\s+følge|tilpligtes|selskabet\s+skal\s+(?:anerkende|betale|dække|yde)|skal\s+dække\s+de"),
)
#: Kinds of defects and the words that show them.
DEFECTS: Rules = (
    ("Skimmel/fugt", r"(?U)\bskimmel\w*|\bfugt\w*|\b\w+fugt\w*|\bkondens\w*"),
    ("Tag/tagdækning", r"(?U)\btag\b|\btag(?:ene|dækning|sten|rende|konstruktion|værk|beklædning|pap|udhæng|fod|flade|rum|vindue|belægning|ryg|hætte|renovering|utæthed|nedløb|folie|plade)\w*|\b(?:i|på|af|under|over|fra|ved|hele|nyt|nye|gamle) taget\b|\bundertag\w*|\b(?:strå|eternit|sadel|pult|valm|mansard|tegl|skifer|bølge|fladt?\s|papp?)tag\w*|\bskotrende\w*|\btagrender\b|\binddækning\w*|\bskorsten\w*"),
    ("Kloak/dræn", r"(?U)\bkloak\w*|\bdræn\w*|\bafløb\w*|\bspildevand\w*|\bfaldstamme\w*|\bfaskine\w*|\bstikledning\w*|\brottespær\w*"),
    ("Installationer", r"(?U)\bel-?install\w*|\belinstall\w*|\bvvs\w*|\bvandinstall\w*|\bvarmeinstall\w*|\bvarmeanlæg\w*|\bfyr(?:et|anlæg|rum)?\b|\bgasfyr\w*|\boliefyr\w*|\bvarmepumpe\w*|\bgulvvarme\w*|\bradiator\w*|\bvandrør\w*|\bvarmerør\w*|\bvandstik\w*|\bstikkontakt\w*|\beltavle\w*|\bventilation\w*|\bcirkulationspumpe\w*|\bvarmtvandsbeholder\w*|\bbrændeovn\w*|\bpejs\w*|\binstallation(?:er|en|erne)?\b"),
    ("Fundament", r"(?U)\bfundament\w*|\bsokkel\w*|\bsætning(?:er|en|erne|sskade\w*)?\b|\bkælder\w*|\bkrybekælder\w*|\bterrændæk\w*"),
    ("Vinduer/døre", r"(?U)\bvindue\w*|\bdør(?:e|en|ene|parti\w*)?\b|\b\w+dør(?:e|en|ene)?\b|\btermorude\w*|\brude(?:r|n|rne)?\b|\bovenlys\w*|\bvelux\w*"),
    ("Murværk/facade", r"(?U)\bmurværk\w*|\bmursten\w*|\bfacade\w*|\bpuds\w*|\bhulmur\w*|\bgavl\w*|\bmurbinder\w*|\bbindere?\b|\bfuge(?:r|rne|n)?\b|\bydervæg\w*|\bmurrevne\w*"),
    ("Råd/svamp/insekt", r"(?U)\bråd(?:skade\w*|dannelse\w*|ne|nede|angreb\w*)?\b|\btrænedbrydende\b|\b\w*svamp\w*(?<!skimmelsvamp)(?<!skimmelsvampen)|\binsekt\w*|\bborebille\w*|\bhusbuk\w*|\bskadedyr\w*|\bmyre(?:r|rne|angreb\w*|tue\w*)?\b|\brotte(?:r|rne|angreb\w*)?\b"),
    ("Konstruktion/bærende", r"(?U)\bbjælke\w*|\bbærende\b|\bspær\w*|\btrækonstruktion\w*|\betageadskillelse\w*|\bkonstruktion(?:en|er|erne|sfejl\w*)?\b|\bstatik\w*|\bbindingsværk\w*|\bloftrum\w*|\bloft(?:et|er)?\b|\bisolering\w*"),
    ("Badeværelse/vådrum", r"(?U)\bbadeværelse\w*|\bvådrum\w*|\bbruse\w*|\bmembran\w*|\bgulvafløb\w*|\btoilet\w*|\bbad(?:et)?\b"),
    ("Gulv", r"(?U)\bgulv(?:e|et|ene|konstruktion\w*|belægning\w*|brædder)?\b|\b(?:træ|klinke|parket|plank|beton|terrazzo|trægulv)gulv\w*|\bparket\w*|\bstrøer\b"),
    ("Ulovlige forhold", r"(?U)\bulovlig\w*|\bbyggetilladelse\w*|\bbygningsreglement\w*|\blovliggør\w*|\bbyggeloven\b|\blokalplan\w*"),
)


def first_label(text: Column, rules: Rules, default: str | None = None) -> Column:
    """The label of the first rule that the text meets."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(label)) for label, p in rules), F.lit(default))


def all_labels(text: Column, rules: Rules) -> Column:
    """The labels of all rules that the text meets, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in rules)))


def folded(text: Column) -> Column:
    """Lower case, words that a line end parted joined, white space as single spaces."""
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)(\w)-\s+(\w)", "$1$2")
    return F.regexp_replace(joined, r"(?U)\s+", " ")


def outcome(title: Column, text: Column, given: Column, known: tuple[str, ...] = ("Medhold", "Delvis medhold", "Ikke medhold", "Afvist")) -> Column:
    """The outcome from the title's last sentence, then its end, then the conclusion, then the field given."""
    tail = F.right(folded(title), F.lit(220))
    sentences = F.filter(F.split(F.trim(tail), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    last = F.coalesce(F.try_element_at(sentences, F.lit(-1)), F.lit(""))
    said = folded(text)
    spaced, plain = F.locate("s e m m e t s e b", F.reverse(said)), F.locate("semmetseb", F.reverse(said))
    back = F.when(spaced > 0, spaced + 16).when(plain > 0, plain + 8).otherwise(1500)
    return F.coalesce(
        first_label(last, TITLE_OUTCOMES), first_label(tail, TITLE_OUTCOMES), first_label(F.right(said, back), TEXT_OUTCOMES), F.when(given.isin(*known), given), F.lit("Ukendt")
    )


def defects(title: Column, text: Column, rules: Rules = DEFECTS, default: str = "Andet") -> Column:
    """Labels that the title shows, else those of the text's start, else the default."""
    a, b = all_labels(F.lower(F.coalesce(title, F.lit(""))), rules), all_labels(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 2000)), rules)
    return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(F.array(F.lit(default)))


def lexicon_labels(tokens: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Labels with a needle among the tokens, as a word or a run of words."""
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    def met(needles: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in needles:
            out = out | (F.contains(line, F.lit(f" {n} ")) if " " in n else F.array_contains(tokens, n))
        return out

    return F.array_compact(F.array(*(F.when(met(needles), F.lit(label)) for label, needles in lexicon.items())))


# The knobs of each kind of query: hyde, expand, filter, lexical, retrieve, final.
INTENTS = {
    "specific": (False, False, False, True, 80, 10), "exact": (False, False, False, True, 120, 20), "case": (True, True, False, False, 100, 15),
    "practice": (True, True, True, False, 120, 18), "factual": (False, True, True, False, 60, 8), "exploratory": (True, True, True, False, 100, 15),
}
#: What shows a kind of query in Danish.
CUES = {
    "exact": ("hvor der står", "som indeholder", "der indeholder", "med formuleringen", "ordret", "den præcise formulering", "nævner", "omtaler", "bruger ordet", "med både", "hvor både", "specifikt indhold", "tekststed"),
    "case": ("min sag", "denne sag", "konkret sag", "konkrete sag", "min anmeldelse", "vil dette være dækket", "er dette dækket", "er forholdet dækket", "vurder sagen", "vurder dette", "hvordan står jeg", "kan jeg få dækning", "bør selskabet dække", "sandsynligvis dækket"),
    "practice": ("praksis", "praksislinje", "tendens", "mønster", "på tværs", "typisk", "generelt", "hvornår får", "hvornår dækker", "hvilke momenter", "hvilke forhold", "hvad lægger nævnet vægt på", "sammenlign", "fordeling"),
    "factual": ("hvad er", "hvad betyder", "hvilken frist", "hvor lang frist", "hvem har", "kan nævnet", "skal selskabet", "må selskabet", "hvilken bestemmelse", "hvad siger betingelserne"),
}
CASE_NUMBER = r"(?i)(?:sag|sagsnummer|kendelse|afgørelse)[ ]*(?:nr[.]?|nummer)?[ ]*[:#]?[ ]*[0-9][0-9./_-]{3,}"


def intent(text: Column, cues: dict[str, tuple[str, ...]] = CUES, number: str = CASE_NUMBER) -> Column:
    """intent, confidence and the knobs: an identifier wins over a quotation or a cue for content, then case, practice,
    fact; else exploratory."""
    said = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " ")))
    n = {k: sum((F.contains(said, F.lit(c)).cast("int") for c in some), F.lit(0)) for k, some in cues.items()}
    short = (F.size(F.split(said, " ")) <= 14) & F.endswith(said, F.lit("?"))
    quoted = said.rlike('["“”„«»][^"“”„«»]{3,250}["“”„«»]')
    kind = F.when(said.rlike(number), "specific").when(quoted | (n["exact"] > 0), "exact").when(n["case"] > 0, "case").when(n["practice"] > 0, "practice").when((n["factual"] > 0) | short, "factual").otherwise("exploratory")
    sure = (
        F.when(kind == "specific", 0.99).when(kind == "exact", 0.95).when(kind == "case", 0.93).when(kind == "practice", F.least(F.lit(0.98), 0.78 + n["practice"] * 0.05))
        .when((kind == "factual") & (n["factual"] > 0), 0.84).when(kind == "factual", 0.62).otherwise(0.55)
    )

    def knob(i: int) -> Column:
        return F.coalesce(*(F.when(kind == k, F.lit(v[i])) for k, v in INTENTS.items()))

    names = ("hyde", "expand", "filters", "lexical", "retrieve", "final")
    return F.struct(kind.alias("intent"), F.bround(sure, 2).alias("confidence"), *(knob(i).alias(name) for i, name in enumerate(names)))


def planned_terms(tokens: Column, concepts: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...], most: int = 10, longest: int = 5) -> Column:
    """Terms that concepts add to a query: those of each concept with a trigger in it, each once, none that is in the
    query already; none for queries of more than ``longest`` tokens."""
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    parts = []
    for triggers, added in concepts:
        met = F.lit(False)
        for t in triggers:
            met = met | F.contains(line, F.lit(f" {t} "))
        parts.append(F.when(met, F.array(*map(F.lit, added))).otherwise(F.array().cast("array<string>")))
    new = F.filter(F.array_distinct(F.concat(*parts)), lambda t: ~F.contains(line, F.concat(F.lit(" "), t, F.lit(" "))))
    return F.when(F.size(tokens) <= longest, F.slice(new, 1, most)).otherwise(F.array().cast("array<string>"))
