"""Stemmers for English and Portuguese by their published rules, whole, as column expressions.

A step looks for the longest of its endings and puts something in its place if a condition on the rest of the word holds.
Regions: R1 is what follows the first non-vowel after a vowel, R2 is the same within R1, and RV (Portuguese) begins after the
next vowel, the next consonant or the third letter, as the first two letters say. Capital letters within a step's endings
mark what an earlier step has cut. Words are lower-cased runs of letters and digits, so apostrophes don't occur; null is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Endings, what takes their place, the region they must be in (1, 2, V; 0 any; -1: what is left ends before R1), and a
    pattern which the rest must hold (or must not, with unless)."""

    endings: str
    then: str = ""
    region: int | str = 0
    where: str = ""
    unless: bool = False


_V, _N = "[aeiouy]", "[^aeiouy]"
_SHORT = f"(?:{_N}{_V}[^aeiouywxY]|^{_V}{_N})$"

#: The published rules, step by step.
ENGLISH_1A = (Rule("sses", "ss"), Rule("ied ies", "i", where="..$"), Rule("ied ies", "ie"), Rule("us", "us"), Rule("ss", "ss"), Rule("s", where=f"{_V}.+$"))
ENGLISH = (
    (Rule("eed eedly", "ee", 1), Rule("ed edly ing ingly", "~", where=_V)),
    (Rule("at~", "ate"), Rule("bl~", "ble"), Rule("iz~", "ize"), *(Rule(f"{c}{c}~", c) for c in "bdfgmnprt"), Rule("~", "e", -1, _SHORT), Rule("~")),
    (Rule("y Y", "i", where=f".{_N}$"),),
    (
        Rule("tional", "tion", 1), Rule("enci", "ence", 1), Rule("anci", "ance", 1), Rule("abli", "able", 1), Rule("entli", "ent", 1), Rule("izer ization", "ize", 1), Rule("ational ation ator", "ate", 1), Rule("alism aliti alli", "al", 1),
        Rule("fulness fulli", "ful", 1), Rule("ousli ousness", "ous", 1), Rule("iveness iviti", "ive", 1), Rule("biliti bli", "ble", 1), Rule("ogi", "og", 1, "l$"), Rule("lessli", "less", 1), Rule("li", "", 1, "[cdeghkmnrt]$"),
    ),
    (Rule("tional", "tion", 1), Rule("ational", "ate", 1), Rule("alize", "al", 1), Rule("icate iciti ical", "ic", 1), Rule("ful ness", "", 1), Rule("ative", "", 2)),
    (Rule("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", "", 2), Rule("ion", "", 2, "[st]$")),
    (Rule("e", "", 2), Rule("e", "", 1, _SHORT, True), Rule("l", "", 2, "l$")),
)
ENGLISH_FORMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ENGLISH_WHOLE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
ENGLISH_R1 = f"^(?:gener|commun|arsen|{_N}*{_V}+{_N})"
ENGLISH_NEXT = f"^{_N}*{_V}+{_N}"

_PV, _PN = "[aeiouáéíóúâêô]", "[^aeiouáéíóúâêô]"
PORTUGUESE_CUT = (
    Rule("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", "", 2),
    Rule("logia logias", "log", 2), Rule("uça~o uço~es", "u", 2), Rule("ência ências", "ente", 2), Rule("amente", "A", 1), Rule("mente", "M", 2), Rule("idade idades", "D", 2), Rule("iva ivo ivas ivos", "B", 2), Rule("ira iras", "ir", "V", "e$"),
)
PORTUGUESE_BEFORE = (
    (Rule("ivA", "B", 2), Rule("ivA", "iv"), *(Rule(f"{x}A", "", 2) for x in ("os", "ic", "ad")), *(Rule(f"{x}A", x) for x in ("os", "ic", "ad")), Rule("A"), Rule("anteM avelM ívelM", "", 2), *(Rule(f"{x}M", x) for x in ("ante", "avel", "ível")), Rule("M"),
     Rule("abilD icD ivD", "", 2), *(Rule(f"{x}D", x) for x in ("abil", "ic", "iv")), Rule("D")),
    (Rule("atB", "", 2), Rule("atB", "at"), Rule("B")),
)
PORTUGUESE_VERB = (Rule(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as "
    "adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis "
    "ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"),)  # fmt: skip
PORTUGUESE_I = (Rule("i", "", "V", "c$"),)
PORTUGUESE_REST = (Rule("os a i o á í ó", "", "V"),)
PORTUGUESE_FORM = ((Rule("e é ê", "E", "V"), Rule("ç", "c")), (Rule("uE", "", "V", "g$"), Rule("uE", "u"), Rule("iE", "", "V", "c$"), Rule("iE", "i"), Rule("E")))
PORTUGUESE_R1 = f"^{_PN}*{_PV}+{_PN}"
PORTUGUESE_RV = f"^(?:{_PV}{_PN}+{_PV}|{_PV}{_PV}+{_PN}|{_PN}{_PN}+{_PV}|{_PN}{_PV}.)"

#: How many letters at the end of a stem may differ from the word's.
CHANGED = {"english": 2, "portuguese": 4}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def after(word: Column, pattern: str, begin: Column | int = 0) -> Column:
    """The place after the pattern, looked for from a place on; the word's end if it isn't found."""
    rest = F.substring(word, F.lit(begin) + 1, F.length(word)) if isinstance(begin, Column) else word
    size = F.length(F.regexp_extract(rest, pattern, 0))
    return F.when(size > 0, size + F.lit(begin)).otherwise(F.length(word))


def step(rules: tuple[Rule, ...], a: Column, within: str | None = None) -> Callable[[Column], Column]:
    """One step as a function of the word. within: endings are looked for in this region alone."""
    endings = sorted({e for r in rules for e in r.endings.split()}, key=lambda e: (-len(e), e))

    def run(w: Column) -> Column:
        where = w if within is None else F.substring(w, a[f"p{within}"] + 1, F.length(w))

        def replaced(e: Column) -> Column:
            rest = F.substring(w, F.lit(1), F.length(w) - F.length(e))
            size, out = F.length(w) - F.length(e), F.when(e == "", w)
            for r in rules:
                fits = e.isin(*r.endings.split())
                if r.region:
                    fits &= size <= a["p1"] if r.region == -1 else size >= a[f"p{r.region}"]
                if r.where:
                    fits &= ~rest.rlike(r.where) if r.unless else rest.rlike(r.where)
                out = out.when(fits, F.concat(rest, F.lit(r.then)))
            return out.otherwise(w)

        return let(F.regexp_extract(where, f"(?:{'|'.join(endings)})$", 0), replaced)

    return run


def chain(word: Column, steps: list[Callable[[Column], Column]]) -> Column:
    return reduce(let, steps, word)


def english(word: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({_V})y", "$1Y")
    regions = lambda m: let(after(m, ENGLISH_R1), lambda p: F.struct(m.alias("m"), p.alias("p1"), after(m, ENGLISH_NEXT, p).alias("p2")))
    rest = lambda a: lambda w: F.when(w.isin(*ENGLISH_WHOLE), w).otherwise(chain(w, [step(s, a) for s in ENGLISH]))
    stem = let(let(marked, regions), lambda a: F.translate(chain(a["m"], [step(ENGLISH_1A, a), rest(a)]), "Y", "y"))
    forms = reduce(lambda c, k: c.when(word.isin(*(w for w, s in ENGLISH_FORMS.items() if s == k)), F.lit(k)), dict.fromkeys(ENGLISH_FORMS.values()), F.when(F.length(word) < 3, word))
    return forms.otherwise(stem)


def portuguese(word: Column) -> Column:
    marked = F.replace(F.replace(word, F.lit("ã"), F.lit("a~")), F.lit("õ"), F.lit("o~"))
    regions = lambda m: let(after(m, PORTUGUESE_R1), lambda p: F.struct(m.alias("m"), p.alias("p1"), after(m, PORTUGUESE_R1, p).alias("p2"), after(m, PORTUGUESE_RV).alias("pV")))

    def stem(a: Column) -> Column:
        verb = lambda w: F.when(w == a["m"], step(PORTUGUESE_VERB, a, "V")(w)).otherwise(w)
        rest = lambda w: F.when(w == a["m"], step(PORTUGUESE_REST, a)(w)).otherwise(step(PORTUGUESE_I, a)(w))
        return chain(a["m"], [step(PORTUGUESE_CUT, a), *(step(s, a) for s in PORTUGUESE_BEFORE), verb, rest, *(step(s, a) for s in PORTUGUESE_FORM)])

    return let(let(marked, regions), lambda a: F.replace(F.replace(stem(a), F.lit("a~"), F.lit("ã")), F.lit("o~"), F.lit("õ")))


LANGUAGES = {"english": english, "portuguese": portuguese}


def stemmed(word: Column, language: str = "english") -> Column:
    """The stem of a lower-cased word."""
    return let(word, LANGUAGES[language])


@lru_cache(maxsize=4096)
def stem_of(word: str, language: str = "english") -> str:
    """The same for one word of a query."""
    return SparkSession.active().range(1).select(stemmed(F.lit(word), language)).head()[0]


def _case(rules: tuple[Rule, ...], w: str, within: str = "") -> str:
    """A step as SQL: the longest ending first, each with its conditions in order."""
    text = lambda x: "'" + x + "'"
    whens = []
    for e in sorted({e for r in rules for e in r.endings.split()}, key=lambda e: (-len(e), e)):
        rest, size, then = f"left({w}, length({w}) - {len(e)})", f"length({w}) - {len(e)}", ""
        for r in rules:
            if e in r.endings.split():
                fits = ["true", *([f"{size} <= p1" if r.region == -1 else f"{size} >= p{r.region}"] if r.region else []), *([f"{'NOT ' * r.unless}regexp_matches({rest}, {text(r.where)})"] if r.where else [])]
                then += f" WHEN {' AND '.join(fits)} THEN {rest} || {text(r.then)}"
        whens.append(f"WHEN ends_with({w}, {text(e)}){f' AND {size} >= {within}' * bool(within)} THEN CASE{then} ELSE {w} END")
    return f"CASE {' '.join(whens)} ELSE {w} END"


def _after(word: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({word}, '{pattern}') THEN length(regexp_extract({word}, '{pattern}')) ELSE length({word}) END"


def stems_sql(words: str, language: str) -> str:
    """DuckDB: word, stem of each row of a relation with a column word."""
    if language == "english":
        marked, first, further = f"regexp_replace(regexp_replace(word, '^y', 'Y'), '({_V})y', '\\1Y', 'g')", ENGLISH_R1, ENGLISH_NEXT
        steps = [_case(ENGLISH_1A, "w"), *(f"CASE WHEN whole THEN w ELSE {_case(s, 'w')} END" for s in ENGLISH)]
        forms = " ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in ENGLISH_FORMS.items())
        last = f"CASE WHEN length(word) < 3 THEN word {forms} ELSE replace(w, 'Y', 'y') END"
    else:
        marked, first, further = "replace(replace(word, 'ã', 'a~'), 'õ', 'o~')", PORTUGUESE_R1, PORTUGUESE_R1
        steps = [_case(PORTUGUESE_CUT, "w"), *(_case(s, "w") for s in PORTUGUESE_BEFORE), f"CASE WHEN w = m THEN {_case(PORTUGUESE_VERB, 'w', 'pV')} ELSE w END",
                 f"CASE WHEN w = m THEN {_case(PORTUGUESE_REST, 'w')} ELSE {_case(PORTUGUESE_I, 'w')} END", *(_case(s, "w") for s in PORTUGUESE_FORM)]
        last = "replace(replace(w, 'a~', 'ã'), 'o~', 'õ')"
    sql = f"SELECT word, m, {_after('m', first)} AS p1, {_after('m', PORTUGUESE_RV)} AS pV FROM (SELECT word, {marked} AS m FROM {words})"
    sql = f"SELECT word, m, m AS w, false AS whole, p1, pV, p1 + {_after('substr(m, p1 + 1)', further)} AS p2 FROM ({sql})"
    whole = f"w IN ({', '.join(repr(x) for x in ENGLISH_WHOLE)})"
    for k, s in enumerate(steps):
        sql = f"SELECT word, m, {s} AS w, {'whole' if k else 'false'} AS whole, p1, p2, pV FROM ({sql})"
        if k == 0 and language == "english":
            sql = f"SELECT word, m, w, {whole} AS whole, p1, p2, pV FROM ({sql})"
    return f"SELECT word, {last} AS stem FROM ({sql})"
