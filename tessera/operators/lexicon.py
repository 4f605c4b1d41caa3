"""Lexicon rules as data, span-exact scans and what is made of the spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.intervals import with_covered


@dataclass(frozen=True)
class Rule:
    label: str
    severity: str
    category: str
    pattern: str
    claim_type: str
    example: str
    stems: tuple = ()


def _rule(label: str, severity: str, category: str, body: str, example: str, claim_type: str | None = None, stems: tuple | None = None) -> Rule:
    return Rule(label, severity, category, body, claim_type or ("disease_based" if severity == "hard" else "wellbeing_based"), example, stems_of(body) if stems is None else stems)


def stems_of(pattern: str) -> tuple:
    """The literals, in lower case, with one of which every match of a pattern begins; none if that can't be told.

    Known are patterns that begin with a word edge and then letters, or a group of such alternatives; an
    optional last letter, and what follows a bracket, brace or other sign, is left off.
    """
    body = pattern.removeprefix(r"\b")
    if body.startswith("(?:"):
        depth, end, starts = 0, None, [3]
        for i, c in enumerate(body):
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 1:
                starts.append(i + 1)
            if c == ")" and depth == 0:
                end = i
                break
        if end is None or body[end + 1 : end + 2] in ("?", "*", "{"):
            return ()
        parts = [body[a : b - 1] for a, b in zip(starts, [*starts[1:], end + 1])]
    else:
        parts = [body]
        if re.search(r"\|(?![^(]*\))", body):
            return ()
    found = []
    for part in parts:
        letters = re.match(r"(?:[^\W\d_]|-)*", part)[0]
        if part[len(letters) : len(letters) + 1] in ("?", "*", "{", "|"):
            letters = letters[:-1]
        found.append(letters.lower())
    return tuple(found) if all(len(x) > 1 for x in found) else ()


# The lexicon. Patterns are matched without regard to case, with Unicode word edges.
RULES = (
    _rule("heil-stem", "hard", "HWG-Heilversprechen", r"\bheil(?!ig\b|ig[a-zäöüß])[a-zäöüß]*\b", "heilen, Heilkraft"),
    _rule("symptom-stem", "hard", "HWG-Krankheitsbezug", r"\bsymptom[a-zäöüß-]*\b", "Symptom"),
    _rule("anwendungsgebiet-stem", "hard", "HWG-Indikation", r"\banwendungs(?:gebiet|bild)[a-zäöüß]*\b", "Anwendungsgebiet"),
    _rule("indikation-stem", "hard", "HWG-Indikation", r"\bindikation[a-zäöüß]*\b", "Indikation"),
    _rule("eindosierung-stem", "hard", "HWG-Pharma-Vokabular", r"\beindosier[a-zäöüß]*\b", "Eindosierung"),
    _rule("dosierung-stem", "hard", "HWG-Pharma-Vokabular", r"\b(?:dosierung[a-zäöüß]*|tagesdosis|tagesdosen|anfangsdosis|einnahmedosis|höchstdosis|hoechstdosis|dosis-empfehlung|dosisempfehlung)\b", "Dosierung, Tagesdosis"),
    _rule("therapie-stem", "hard", "HWG-Therapiebezug", r"\b(?:therapie[a-zäöüß]*|therapeutisch[a-zäöüß]*)\b", "Therapie"),
    _rule("diagnose-stem", "hard", "HWG-Krankheitsbezug", r"\bdiagnos[a-zäöüß]*\b", "Diagnose"),
    _rule("lindern-stem", "hard", "HWG-Krankheitsbezug", r"\blinder[a-zäöüß]*\b", "lindern, Linderung"),
    _rule("vorbeugen-stem", "hard", "HWG-Krankheitsvorbeugung", r"\bvorbeug[a-zäöüß]*\b", "vorbeugen", "reduction_based"),
    _rule("heilanzeige-stem", "hard", "HWG-Indikation", r"\bheilanzeige[a-zäöüß]*\b", "Heilanzeige"),
    _rule("beschwerde-medical", "hard", "HWG-Krankheitsbezug", r"\b(?:magen|darm|gelenk|kopf|menstruations|verdauungs|prostata|periode[n]?)beschwerde[a-zäöüß]*\b", "Magenbeschwerden"),
    _rule("wirkmechanismus", "hard", "HWG-Wirkversprechen", r"\bwirkmechanism[a-zäöüß]*\b", "Wirkmechanismus", "health_based"),
    _rule("wohlbefinden", "soft", "HCVO-Art10Abs3-Wohlbefinden", r"\bwohlbefinden[a-zäöüß]*\b", "Wohlbefinden"),
    _rule("entspannung-stem", "soft", "HCVO-Art10Abs3-Wohlbefinden", r"\bentspann(?:ung|end|t|en)[a-zäöüß]*\b", "Entspannung"),
    _rule("widerstandsfaehigkeit", "soft", "HCVO-Synonym-Immunsystem", r"\bwiderstands(?:kraft|fähigkeit|faehigkeit)[a-zäöüß]*\b", "Widerstandskraft"),
    _rule("abwehrkraft", "soft", "HCVO-Synonym-Immunsystem", r"\babwehrkr(?:aft|äfte|aefte)[a-zäöüß]*\b", "Abwehrkräfte"),
    _rule("vitalitaet", "soft", "HCVO-Art10Abs3-Wohlbefinden", r"\bvitalit(?:ät|aet)[a-zäöüß]*\b", "Vitalität"),
    _rule("boosten", "soft", "HCVO-Wirkversprechen-Slang", r"\bboost(?:e[nrst]?|er[a-zäöüß]*)\b", "boosten, Booster"),
    _rule("mentale-anspannung", "soft", "HCVO-Stresskontext", r"\bmentale[rmns]?\s+anspannung[a-zäöüß]*\b", "mentale Anspannung"),
    _rule("koerperliche-anspannung", "soft", "HCVO-Stresskontext", r"\b(?:körperliche|koerperliche)[rmns]?\s+anspannung[a-zäöüß]*\b", "körperliche Anspannung"),
    _rule("mentales-wohlbefinden", "soft", "HCVO-Art10Abs3-Wohlbefinden", r"\bmental(?:e[srn]?)?\s+wohlbefinden[a-zäöüß]*\b", "mentales Wohlbefinden"),
    _rule("foerderung-wohlbefinden", "soft", "HCVO-Art10Abs3-Wohlbefinden", r"\bf(?:ö|oe)rderung\s+(?:de[srn]?\s+)?wohlbefinden[a-zäöüß]*\b", "Förderung des Wohlbefindens", stems=("förderung", "foerderung")),
    _rule("adaptogen-term", "soft", "HCVO-Adaptogen-Begriff", r"\badaptogen[a-zäöüß]*\b", "Adaptogen"),
)

HIT = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("label", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


#: Letters that match others without regard to case, besides their own lower and upper case.
_FOLDED = {"ſ": "s", "ı": "i", "İ": "i", "K": "k"}


def folded(text: str) -> str:
    """A text in lower case, character by character, so that offsets stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    # replaced one by one, as translate() looks up every character and these are hardly ever there
    for letter, plain in _FOLDED.items():
        low = low.replace(letter, plain)
    return low


class Scanner:
    """All hits of many rules in one pass: an automaton over their stems finds places, where the rule's own pattern decides.

    A rule without stems is searched by its pattern alone.
    """

    def __init__(self, rules: list):
        self.rules = [(r.label, r.severity, re.compile(r.pattern, re.IGNORECASE), r.stems) for r in rules]
        owners: dict = {}
        for k, (*_, stems) in enumerate(self.rules):
            for stem in stems:
                owners.setdefault(folded(stem), []).append(k)
        self.loose = [k for k, (*_, stems) in enumerate(self.rules) if not stems]
        self.automaton = ahocorasick.Automaton()
        for stem, own in owners.items():
            self.automaton.add_word(stem, (len(stem), tuple(dict.fromkeys(own))))
        if owners:
            self.automaton.make_automaton()
        self.tried = 0

    def hits(self, text: str) -> list:
        places: dict = {}
        if len(self.automaton):
            for end, (size, own) in self.automaton.iter(folded(text)):
                for k in own:
                    places.setdefault(k, []).append(end - size + 1)
        found = []
        for k, starts in places.items():
            label, severity, pattern, _ = self.rules[k]
            after = 0
            for start in sorted(starts):
                if start >= after:
                    self.tried += 1
                    m = pattern.match(text, start)
                    if m and m.end() > start:
                        found.append((m.start(), m.end(), label, severity, m[0]))
                        after = m.end()
        for k in self.loose:
            label, severity, pattern, _ = self.rules[k]
            found += [(m.start(), m.end(), label, severity, m[0]) for m in pattern.finditer(text)]
        return [{"term": term, "label": label, "severity": severity, "start": start, "end": end} for start, end, label, severity, term in sorted(found)]


def find_terms(rules=RULES, severities: tuple = ("hard", "soft")):
    """A function of a text column: all hits of all rules, by start, end and label; offsets in code points.

    Spark has no function that returns match offsets in code points, so this is one pass in a pandas UDF.
    """
    chosen = [r for r in rules if r.severity in severities]

    @F.pandas_udf(HIT)
    def scan(texts: pd.Series) -> pd.Series:
        scanner = Scanner(chosen)
        return texts.map(lambda t: scanner.hits(t or ""))

    return scan


def claim_type(label: Column, severity: Column, rules=RULES) -> Column:
    """The claim type of a hit: its rule's, else that of its severity."""
    known = F.create_map(*[F.lit(x) for r in rules for x in (r.label, r.claim_type)])
    return F.coalesce(F.element_at(known, label), F.when(severity == "hard", "disease_based").otherwise("wellbeing_based"))


def any_of(rules) -> str:
    """A pattern that matches where any rule does.

    If all rules begin with a word edge and their stems are known, the edge and the stems' first letters are
    looked at once for each place of a text, and not once for each rule.
    """
    if not rules or any(not r.stems or not r.pattern.startswith(r"\b") or _alternatives(r.pattern) for r in rules):
        return "|".join(f"(?:{r.pattern})" for r in rules)
    first = "".join(sorted({re.escape(s[0]) for r in rules for s in r.stems}))
    return rf"\b(?=[{first}])(?:" + "|".join(f"(?:{r.pattern[2:]})" for r in rules) + ")"


def _alternatives(pattern: str) -> bool:
    """Whether a pattern may have alternatives outside all brackets."""
    return re.search(r"\|(?![^(]*\))", re.sub(r"\\.|\[[^\]]*\]", "", pattern)) is not None


def has_terms(text: Column, rules=RULES, severities: tuple = ("hard", "soft")) -> Column:
    """Whether any rule matches, inside the JVM."""
    return text.rlike("(?iuU)" + any_of([r for r in rules if r.severity in severities]))


def count_terms(text: Column, rules=RULES) -> Column:
    """struct of hit counts by rule label, inside the JVM; a text in which no rule matches at all is passed once."""
    counts = F.struct(*[F.regexp_count(text, F.lit("(?iuU)" + r.pattern)).alias(r.label) for r in rules])
    none = F.struct(*[F.lit(0).alias(r.label) for r in rules])
    return F.when(text.isNull() | has_terms(text, rules), counts).otherwise(none)


def spans(docs: DataFrame, rules=RULES, severities: tuple = ("hard", "soft"), key: str = "doc_id") -> DataFrame:
    """One row for each hit: key, term, label, severity, start, end.

    All texts go to the scan: it passes a text once for all rules, and costs less than a pattern of all rules before it.
    """
    found = find_terms(rules, severities)(F.col("text"))
    return docs.select(key, F.explode(found).alias("h")).select(key, "h.*")


def literal_hits(text: Column, terms: list) -> Column:
    """array<struct<term,start,end,spelled>>: occurrences of literal lower-case terms, without regard to the case of A-Z, without overlaps of a term with itself.

    Splitting the text by a literal leaves the gaps, whose running lengths are the offsets in code points.
    """

    def starts(term: str) -> Column:
        gaps = F.split(text, r"(?i)\Q" + term + r"\E", -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("s"))
        step = lambda a, g: F.struct((a["at"] + F.length(g) + len(term)).alias("at"), F.array_append(a["s"], a["at"] + F.length(g)).alias("s"))
        found = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), start, step, lambda a: a["s"])
        return F.when(F.contains(F.lower(text), F.lit(term)), found).otherwise(F.array().cast("array<int>"))

    row = lambda term: lambda s: F.struct(F.lit(term).alias("term"), s.alias("start"), (s + len(term)).alias("end"), F.substr(text, s + 1, F.lit(len(term))).alias("spelled"))
    return F.concat(*[F.transform(starts(t), row(t)) for t in terms])


def literal_spans(docs: DataFrame, terms: list, key: str = "doc_id") -> DataFrame:
    """One row for each of literal_hits: key, term, start, end, spelled."""
    return docs.select(key, F.explode(literal_hits(F.col("text"), terms)).alias("h")).select(key, "h.*")


def longest_per_start(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the hits that begin at one offset the longest; of equals the first by label."""
    order = W.partitionBy(key, "start").orderBy(F.desc("end"), "label")
    return hits.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def uncovered(hits: DataFrame, cover: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits that lie inside no span of cover."""
    return with_covered(hits, cover, key).where("not covered").drop("covered")


def summary(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each key its different terms without regard to case, first spelling, in order of first occurrence."""
    first = hits.groupBy(key, F.lower("term").alias("_low")).agg(F.min(F.struct("start", "end", "term")).alias("f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["term"]).alias("terms"))


def prompt_block(rules=RULES) -> str:
    """The examples of each severity, for a prompt."""
    lines = [f"{s}: " + ", ".join(sorted({e.strip() for r in rules if r.severity == s for e in r.example.split(",")})) for s in ("hard", "soft")]
    return "\n".join(lines)


def new_terms(after: DataFrame, before: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits after an edit whose term, without regard to case, wasn't there before; each occurrence stays."""
    old = before.select(F.col(key).alias("_k"), F.lower("term").alias("_t")).distinct()
    return after.join(old, (after[key] == old["_k"]) & (F.lower(after["term"]) == old["_t"]), "left_anti")
