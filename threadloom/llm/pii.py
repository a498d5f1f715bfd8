"""Personal information inside free text (problem 4).

Mail addresses, phones, identity numbers and streets identify by themselves; expressions
in the JVM nominate them. Names have no shape, so the corpus tells them: a term's
disclosure is the information (in bits) that seeing it gives about a protected entity,
estimated from how often it stands beside mail addresses and identity numbers and how
often it occurs at all. Terms above the threshold are name terms; a given and a family
name side by side are a found name, and what ends a French street is told by the share
of its continuations. In the sanitised text found values become typed placeholders at
their own places, and terms of found names that disclose by themselves, since many of
their uses are in names, are generalised to <NAME> wherever they stand alone.
Statistics cover the whole corpus, and all joins are on terms or turn ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.tables import with_row

#: Least information in bits (16 times as telling as any word; with every word of the corpus counted, given names of the test
#: tables have 9 and more), and least share of a term's uses that stand beside a protected entity.
MIN_BITS, MIN_SHARE = 4.0, 0.02
#: A second capitalised word belongs to a street if this share of the first one's uses has it.
STREET_SHARE = 0.5
#: A term of found names discloses by itself if at least this share of the turns it occurs in name it so.
LONE_SHARE = 0.25

_AT = r"(?:@| ?[\[({] ?(?:at|AT|At) ?[\])}] ?)"
_DOMAIN = r"(?>(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,})"
EMAIL = (
    r"(?<![\p{L}\p{N}_.+/@%-])(?<!://[^\s@]{0,120})(?<!\b(?:ssh|scp|sftp|rsync|mosh)\b[^\n@]{0,60})"
    rf"[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}._%+-]*{_AT}{_DOMAIN}(?![\p{{L}}\p{{N}}_@-]|:[\p{{L}}\p{{N}}/~])"
)
PHONE = (
    r"(?<![\p{L}\p{N}_.+/-])(?<!\d[ .-])(?:"
    r"(?=\+(?:[ .()-]{0,2}\d){8,15}(?!\d))\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,12}){1,6}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4}"
    r"|\(0\d{2,4}\) ?\d{3,8}|0\d{1,4}/\d{3,6}(?:[ -]\d{2,5})?|0\d{4} \d{6}|0\d{3} \d{3} \d{3,4}|0\d{2} \d{4} \d{4}|0\d(?:[. ]\d\d){4}"
    r")(?![\p{L}\p{N}_]|[.-]\d|[ ]\d{2,}(?![\p{L}]))"
)
# Labels that identity numbers carry.
_ID_LABEL = (
    r"(?:SSN|social security (?:number|no\.?)|Steuer-?ID(?:nummer)?|Steuernummer|tax id|DNI|NIE|NIF|NI number|NINO|national insurance(?: number| no\.?)?"
    r"|passport(?: no\.?| number)?|Reisepass(?:nummer| Nr\.?)?|pasaporte|passeport(?: n°)?|driv(?:er|ing)'?s? licen[cs]e(?: no\.?| number)?|F(?:ü|ue)hrerschein(?:nummer)?|permis de conduire|Personalausweis(?:nummer)?|ID card(?: no\.?)?)"
)
_ID_VALUE = r"(\d{3}[- ]\d{2}[- ]\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{8}-?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]-\d{4}-\d{4}|[XYZ]\d{7}[A-Z]|[A-Z]{1,3}\d{6,9}|\d{9,11})(?![\p{L}\p{N}]|-\d)"
ID_NUMBER = rf"(?i:(?=[sdntprfi])\b{_ID_LABEL})\s*[:=#]?\s*{_ID_VALUE}"
# Street words in four languages.
_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Close|Crescent|Way|Drive|Dr|Terrace|Place|Square|Boulevard|Blvd|Row|Mews|Grove|Gardens)"
_FR = r"(?:rue|avenue|boulevard|place|chemin|all[ée]e|quai|impasse|cours|route)"
_LINK = r"(?:(?:de la|de l'|du|des|de|d') ?)?"
_CAP = r"\p{Lu}\p{L}*(?:['’-]\p{L}+)*"
ADDRESS = (
    r"(?=[\p{Lu}\d])(?:"  # skips fast where none can start
    rf"(?<![\p{{L}}\p{{N}}_.,/:-])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,2}}{_EN}(?![\p{{L}}\p{{N}}_])(?! (?:workers?|runners?|jobs?|tasks?|slots?|nodes?|threads?|queues?|entries|items|lanes)\b)"
    rf"|(?:\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrer|Ronda)|\bC/) ?(?:(?:de la|de los|de las|del|de|la|las|los|el) )?{_CAP}(?: {_CAP}){{0,3}},? (?:n\.? ?º ?)?\d{{1,4}}[A-Za-z]?(?![\p{{L}}\p{{N}}])"
    rf"|\b(?:(?:Am|An der|An den|Auf der|Auf dem|Zum|Zur|Unter den|In der|Alte|Alter|Neue) {_CAP}|{_CAP}(?:straße|strasse|str\.|weg|stieg|steig|allee|gasse|platz|ring|damm|ufer|hang|berg|hof)) \d{{1,4}}[a-zA-Z]?(?![\p{{L}}\p{{N}}]|[.,:-]\d| \d)"
    r")"
)
FRENCH = rf"(?<![\p{{L}}\p{{N}}_.,/:-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?i:{_FR}) {_LINK}{_CAP}(?: {_CAP})?"

_WORD = r"\p{L}+(?:['’-]\p{L}+)*"
_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|la|le|ten|ter|zu|zur|bin|ibn|al|el|af|av)"
_FAMILY = rf"(?:{_PARTICLE} )*{_CAP}"
#: A full name directly beside a mail address or an identity number.
SLOT = rf"({_CAP}) ({_FAMILY})(?= <[^\s<>@]+{_AT}|;[^\s;@]+{_AT}|,? \((?i:{_ID_LABEL})\b)"


def _values(kind: str, text: Column, pattern: str, group: int = 0) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("found")))


def shaped(turns: DataFrame) -> DataFrame:
    """(turn_id, kind, found) of all kinds but names, as often as each occurs."""
    t = F.col("content")
    has_at, has_digit = t.rlike("@|(?i:[\\[({] ?at ?[\\])}])"), t.rlike(r"\d")
    none = F.array().cast("array<struct<kind:string,found:string>>")
    every = F.concat(
        F.when(has_at, _values("email", t, EMAIL)).otherwise(none),
        F.when(t.rlike(r"\d{3}|\d[. ]\d\d[. ]"), _values("phone", t, PHONE)).otherwise(none),
        F.when(t.rlike(rf"(?i)(?=[sdntprfi]){_ID_LABEL}") & has_digit, _values("id_number", t, ID_NUMBER, 1)).otherwise(none),
        F.when(t.rlike(r"\d[A-Za-z]? \p{Lu}|\p{L},? \d"), _values("address", t, ADDRESS)).otherwise(none),
        F.when(t.rlike(rf"\d,? (?i:{_FR}) "), _values("french", t, FRENCH)).otherwise(none),
    )
    rows = turns.where("id is not null and content is not null").select(F.col("id").alias("turn_id"), F.explode(every).alias("v")).select("turn_id", "v.kind", "v.found")
    rows = materialise(rows, "shaped")  # read three times below, found once
    # The end of a French street is open: a second capitalised word belongs to it if it
    # follows the first one in most of the corpus.
    fr = rows.where("kind = 'french'").withColumn("short", F.regexp_extract("found", rf"^(.*?{_LINK}{_CAP})(?: {_CAP})?$", 1))
    fr = fr.withColumn("short", F.when(F.col("found").rlike(rf" {_CAP} {_CAP}$"), F.regexp_replace("found", rf" {_CAP}$", "")).otherwise(F.col("found")))
    fr = fr.withColumn("street", F.regexp_replace("short", r"^\d+(?: ?(?:bis|ter))?,? ", "")).withColumn("more", F.expr("substring(found, length(short) + 1)"))
    uses = fr.groupBy("street", "more").agg(F.count("*").alias("n")).groupBy("street").agg(F.sum("n").alias("n"), F.max_by("more", F.when(F.col("more") != "", F.col("n"))).alias("next"), F.max(F.when(F.col("more") != "", F.col("n"))).alias("n_next"))
    whole = F.coalesce(F.col("n_next") >= STREET_SHARE * F.col("n"), F.lit(False)) & (F.col("more") == F.col("next"))
    streets = fr.join(uses, "street").select("turn_id", F.lit("address").alias("kind"), F.when(whole, F.col("found")).otherwise(F.col("short")).alias("found"))
    return rows.where("kind <> 'french'").unionByName(streets)


def slots(turns: DataFrame) -> DataFrame:
    """(given, family, n): full names directly beside a protected entity, lower case."""
    t = F.col("content")
    near = t.rlike("@|(?i:[\\[({] ?at ?[\\])}])") | t.rlike(rf"\((?i:{_ID_LABEL})\b")
    whole = F.regexp_extract_all(t, F.lit(SLOT), F.lit(0))
    rows = turns.where(near).select(F.explode(whole).alias("name"))
    given = F.substring_index("name", " ", 1)
    return rows.select(F.lower(given).alias("given"), F.lower(F.expr("substring(name, length(substring_index(name, ' ', 1)) + 2)")).alias("family")).groupBy("given", "family").agg(F.count("*").alias("n"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def term_uses(turns: DataFrame, seen: DataFrame) -> DataFrame:
    """(turn_id, term): the turns in which each word of a name in a slot occurs, written once."""
    family = F.filter(F.split("family", " "), lambda w: (F.length(w) > 2) & ~w.rlike(f"^{_PARTICLE}$"))
    terms = seen.select(F.explode(F.concat(F.array("given"), family)).alias("term")).distinct()
    words = turns.where("id is not null and content is not null").select(F.col("id").alias("turn_id"), F.explode(_words(F.col("content"))).alias("term"))
    return materialise(words.join(terms, "term"), "uses")


def disclosing(turns: DataFrame, uses: DataFrame, beside: DataFrame, least_share: float) -> DataFrame:
    """(term, bits) of the terms whose disclosure reaches MIN_BITS; *beside* are (term, n), n times beside a protected entity.

    bits = log2 of P(protected entity beside | term) / P(protected entity beside any word),
    with all words of the corpus counted.
    """
    n_words = turns.where("id is not null and content is not null").agg(F.sum(F.size(F.regexp_extract_all("content", F.lit(_WORD), F.lit(0)))).cast("double").alias("n_words"))
    base = with_row(beside.agg(F.sum("n").alias("n_all")), n_words)
    per = with_row(uses.groupBy("term").agg(F.count("*").alias("n_uses")).join(beside, "term"), base)
    share = F.col("n") / F.col("n_uses")
    bits = F.log2(share / (F.col("n_all") / F.col("n_words")))
    return per.where((share >= least_share) & (bits >= MIN_BITS)).select("term", bits.alias("bits"))


def _evidence(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names in slots and the uses of their words, each written once."""
    seen = materialise(slots(turns), "slots")
    return seen, term_uses(turns, seen)


def names(turns: DataFrame, evidence: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(turn_id, kind, found): given and family name side by side, in either order and any case."""
    seen, uses = evidence or _evidence(turns)
    givens = disclosing(turns, uses, seen.groupBy(F.col("given").alias("term")).agg(F.sum("n").alias("n")), MIN_SHARE).select("term")
    hits = uses.join(givens, "term", "left_semi").select("turn_id", F.col("term").alias("given"))
    families = seen.join(givens.withColumnRenamed("term", "given"), "given", "left_semi").select("family").distinct()
    at = turns.where("id is not null").select(F.col("id").alias("turn_id"), "content").join(hits.distinct(), "turn_id").distinct()
    before, after = rf"(?:{_WORD} ){{0,3}}{_WORD},? $", rf"^(?: {_WORD}){{1,4}}"
    # Each occurrence of the given name cuts the text; the pieces beside it hold the family name.
    cut = F.expr("split(content, concat('(?iu)(?<![\\\\p{L}\\\\p{N}_.+@''’-])\\\\Q', given, '\\\\E(?![\\\\p{L}\\\\p{N}_@’-]|''\\\\p{L}|\\\\.\\\\p{L})'))")
    parts = at.select("turn_id", "given", "content", F.posexplode(cut).alias("i", "part")).withColumn("part_len", F.length("part"))
    w = Window.partitionBy("turn_id", "given", "content").orderBy("i")
    laid = parts.withColumn("next", F.lead("part").over(w)).where("next is not null").withColumn("start", F.sum("part_len").over(w) + F.col("i") * F.length("given"))
    laid = laid.withColumn("as_written", F.expr("substring(content, start + 1, length(given))"))
    left, right = F.regexp_extract("part", before, 0), F.regexp_extract("next", after, 0)
    sides = laid.select("turn_id", "as_written", left.alias("left"), right.alias("right"), "i", "start")
    n_left = F.split(F.regexp_replace("left", r",? $", ""), " ")
    lefts = F.transform(F.sequence(F.lit(1), F.least(F.size(n_left), F.lit(4))), lambda k: F.struct(F.array_join(F.slice(n_left, F.size(n_left) - k + 1, k), " ").alias("fam"), F.lit(True).alias("is_left")))
    n_right = F.split(F.trim("right"), " ")
    rights = F.transform(F.sequence(F.lit(1), F.least(F.size(n_right), F.lit(4))), lambda k: F.struct(F.array_join(F.slice(n_right, 1, k), " ").alias("fam"), F.lit(False).alias("is_left")))
    none = F.array().cast("array<struct<fam:string,is_left:boolean>>")
    cands = sides.select(
        "turn_id", "as_written", "left", "start",
        F.explode(F.concat(F.when(F.col("left") != "", lefts).otherwise(none), F.when(F.col("right") != "", rights).otherwise(none))).alias("c"),
    ).select("turn_id", "as_written", "left", "start", "c.fam", "c.is_left")
    known = cands.join(families, F.lower("fam") == F.col("family"))
    best = known.groupBy("turn_id", "start").agg(F.max_by(F.struct("as_written", "left", "fam", "is_left"), F.struct(~F.col("is_left"), F.length("fam"))).alias("b"))
    comma = F.when(F.col("b.left").endswith(", "), ", ").otherwise(" ")
    value = F.when(F.col("b.is_left"), F.concat("b.fam", comma, "b.as_written")).otherwise(F.concat_ws(" ", "b.as_written", "b.fam"))
    return best.select("turn_id", F.lit("name").alias("kind"), value.alias("found"))


def found(turns: DataFrame) -> DataFrame:
    """(turn_id, kind, found), distinct. Null ids and null or empty texts give none; repeated rows count once."""
    return shaped(turns).unionByName(names(turns)).distinct()


_ALONE = re.compile(r"(?<![\w@./+’'-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@/+]|[.’'-]\w)")


def _put(text: str, values: list[tuple[str, str]], terms: set[str]) -> str:
    """*text* with placeholders for *values* (found, kind), longest first, where they stand as wholes, and <NAME> for lone *terms*."""
    taken: list[tuple[int, int, str]] = []

    def take(a: int, z: int, mark: str) -> None:
        if all(z <= x or a >= y for x, y, _ in taken):
            taken.append((a, z, mark))

    for found, kind in sorted(values, key=lambda v: (-len(v[0]), v)):
        left, right = (r"(?<![^\W_])" if found[0].isalnum() else ""), (r"(?![^\W_])" if found[-1].isalnum() else "")
        for m in re.finditer(left + re.escape(found) + right, text):
            take(*m.span(), f"<{kind.upper()}>")
    if terms:
        for m in _ALONE.finditer(text):
            if m[0].lower() in terms:
                take(*m.span(), "<NAME>")
    for a, z, mark in sorted(taken, reverse=True):
        text = text[:a] + mark + text[z:]
    return text


def sanitise(turns: DataFrame) -> DataFrame:
    """(turn_id, content): every turn once, found values replaced by typed placeholders such as <EMAIL>.

    Longer values are replaced first, where they stand as wholes, so no placeholder
    stands inside another value or word. Terms of found names that stand alone become
    <NAME> if they disclose: if LONE_SHARE of their uses are in names. Only turns with a value
    or such a term leave the JVM; null ids have no row, null texts stay null.
    """
    evidence = _evidence(turns)
    named = materialise(names(turns, evidence), "names")
    rows = shaped(turns).unionByName(named).distinct()
    inside = named.select("turn_id", F.explode(_words(F.col("found"))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n"))
    lone = evidence[1].join(disclosing(turns, evidence[1], inside, LONE_SHARE).select("term"), "term", "left_semi").distinct()
    marks = rows.unionByName(lone.select("turn_id", F.lit("").alias("kind"), F.col("term").alias("found"))).groupBy("turn_id").agg(F.collect_set(F.struct("found", "kind")).alias("marks"))
    text = turns.where("id is not null").groupBy(F.col("id").alias("turn_id")).agg(F.max("content").alias("content"))
    both = text.join(marks, "turn_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_put(t, [(m["found"], m["kind"]) for m in ms if m["kind"]], {m["found"] for m in ms if not m["kind"]}) for t, ms in zip(b["content"], b["marks"])]
            yield pd.DataFrame({"turn_id": b["turn_id"], "content": out})

    both = materialise(both, "marked")  # the shuffles once, for both halves
    return both.where("marks is null").select("turn_id", "content").unionByName(both.where("marks is not null").mapInPandas(run, "turn_id string, content string"))
