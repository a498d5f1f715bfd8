"""Template residue, filler and error-page text (problem 10).

A notice comes back: the same few words under addresses and titles that have nothing to
do with them. So each short body is compared with its address slug and its title, and
its masked form (numbers, ids and hosts left out) is counted over the corpus: a body
that shares no term with its address or title and comes back under several hosts needs
only one term that notices use. A body without that evidence needs three, one of them
such as only notices use. Bodies that speak about notices, in either case, are none.
Beside it placeholder detectors look at the prose, outside code and quoted examples, for
placeholders, template tags, filler and author instructions. Forms are counted with
map-side combine and come back by a join on their digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise

#: A body of at most so many words may be nothing but a notice.
SHORT_WORDS = 60
#: Notice terms a short body needs, and those of a mismatched body that comes back under several hosts.
NOTICE_TERMS, NOTICE_TERMS_SHARED = 3, 1
#: Notice terms per word of a notice, at least.
NOTICE_DENSITY = 0.1
#: Copies of a masked body, under so many hosts, that count as host evidence.
SHARED_DOCS, SHARED_HOSTS = 3, 2
#: Filler words in a text, and their share of a line, that make it filler.
FILLER_WORDS, FILLER_SHARE = 6, 0.5

# What only notices say, in four languages; each entry counts once.
NOTICE_STRONG = [
    r"\b(?:error|erreur|fehler)\b\D{0,20}\d{3}\b|^\W*(?:http\W*)?[45]\d\d\b|\"code\":\s*[45]\d\d|<(?:title|h1)>\W*[45]\d\d",
    r"not found|could not be found|no longer (?:exists|available)|no encontrad[ao]|nicht gefunden|introuvable|non trouvée|does not exist",
    r"access (?:is )?denied|forbidden|(?:not have|no|without) permission|permission denied|not authori[sz]ed|unauthori[sz]ed|zugriff verweigert|keine berechtigung|accès (?:refusé|interdit)|acceso denegado|no tiene permiso",
    r"\benable\b|turn on|activate|aktivieren|activez|activer|habilit[ae]|active\b|not supported",
    r"maintenance|wartung|mantenimiento|be back|back shortly|down for",
    r"unavailable|not available|nicht verfügbar|indisponible|no (?:está )?disponible|temporarily",
    r"expired|abgelaufen|expiré|caducad[ao]|timed? ?out",
    r"sign in|log in|anmelden|connectez|connecter|inicie sesión",
    r"too many requests|rate limit|trop de requêtes|zu viele anfragen|demasiadas solicitudes",
    r"reference #|request id|\bray\b|incident|traceback id|error id|correlation id",
    r"checking your|verify(?:ing)? (?:that )?you|are (?:a )?human|captcha",
    r"before you proceed|continue to \S+\.\S+|your connection",
    r"bad request|service unavailable|bad gateway|internal server error|not acceptable|gone\b|conflict\b|\"error\":",
]
# What notices say too; these alone make none.
NOTICE_WEAK = [
    r"javascript|\bscripts?\b|\bcookies\b|\bbrowser\b|navigateur|navegador",
    r"session|sitzung|sesión|logged out|signed out",
    r"gateway|proxy|upstream|\bserver\b|serveur|servidor",
    r"slow down|retry|try again|reload|refresh|neu laden|erneut|recharge[rz]?|réessaye[rz]?|intente|recargue",
    r"(?:after|in) \d+ ?s(?:econds?)?\b|a few (?:seconds|minutes)|shortly|later\b|später|plus tard|más tarde",
    r"the (?:page|content|document|resource|file)(?: you)?(?: (?:requested|are looking for))?|this (?:page|content|document)|diese seite|cette page|la página|esta página|página de inicio|home page|startseite|page d'accueil",
    r"you requested|you do not have|please|bitte|veuillez|por favor|vuelva|retournez|zurück",
    r"blocked|disabled|required|requires|nécessite|erforderlich|requiere|deaktiviert",
]
# How texts speak that make notices their subject.
SUBJECT = r"\btests?\b|checks? that|shows? an? |redesigned|returns? an? |\bclient\b|\bhandler\b|log the |\bwe (?:show|render|return|send|log)|users? sees?|now says|^(?:human|user|assistant):|```|`"
HOST = r"\b[\w-]+(?:\.[\w-]+)+\b"
# Filler vocabulary.
FILLER = "lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|veniam|nostrud|exercitation|ullamco|laboris|aliquip|commodo|consequat"
# What unfilled templates and author instructions look like in prose.
PLACEHOLDER_SIGNS = [
    r"\{\{[^{}\n]{0,80}\}\}",
    r"\{%[^%\n]{0,80}%\}",
    r"<%[^%\n]{0,80}%>",
    r"\$!?\{[A-Za-z_][\w.]{0,60}\}",
    r"#set\(\$\w+",
    r"\[\[ ?[A-Za-z_]\w{0,60} ?\]\]",
    r"(?<![\w/.])__[A-Z][A-Z0-9_]{1,40}__(?!\w)",
    r"(?<![\w%])%[A-Z][A-Z0-9_]{2,40}%(?!\w)",
    r"(?i)\[(?:insert|enter|add|your|fill in|replace|describe|company|project|client)\b[^\]\n]{0,60}\]",
    r"(?i)\[[^\]\n]{0,40}\b(?:eintragen|einfügen|einsetzen|ergänzen|hier|ici|insérer|aquí|insertar|here)\b[^\]\n]{0,20}\]",
    r"(?i)<(?:your|my|insert|enter|the)[ _-][^<>\n]{1,40}>",
    r"(?i)<(?:name|team|owner|project|date|company|component|version|product|email|title)(?:[ _-][\w -]{1,30})?>(?![^<]*</)",
    r"(?<![\w$%#{\"'(=])\{[A-Z][A-Za-zÄÖÜäöüß_]{1,40}\}(?!\w)",
]
# The same in words, and what each of them contains in lower case.
PLACEHOLDER_WORDS = [
    r"\bundefined undefined\b|\bNaN (?:days|hours|minutes|seconds|items|%)|\[object Object\]|\bnull null\b",
    r"\bXX[X]{2,}\b|\bYYYY-MM-DD\b|\bTT\.MM\.JJJJ\b|\bJJ/MM/AAAA\b|\bDD/MM/(?:YYYY|AAAA)\b|\bMM/DD/YYYY\b",
    r"(?i)\b(?:TODO|TBD|FIXME)\s*:\s*(?:describe|write|fill|add|explain|insert|replace|complete|document|provide|update|mention)\b",
    r"(?i)\bto be (?:replaced|filled in|completed|written|defined|added) by the (?:author|writer|owner|team)\b|\bplaceholder text\b",
    r"(?i)\b(?:your|enter|insert|add|type) (?:text|content|title|description|summary|name)(?: goes)? here\b|\bgoes here\b",
    r"(?i)\breplace this (?:text|paragraph|section|sentence|line|placeholder)\b|\bremplacez ce (?:texte|paragraphe)\b|\bersetzen sie diesen (?:text|absatz)\b|\bdiesen (?:text|absatz) ersetzen\b|\b(?:reemplace|sustituya) este (?:texto|párrafo)\b",
    r"(?i)\b(?:hier|hier bitte) (?:text|inhalt|beschreibung) (?:einfügen|eintragen)\b|\binsérez (?:votre|le) texte\b|\b(?:inserte|escriba) (?:aquí )?(?:el|su) texto\b",
    r"(?m)^#+ (?:Section heading|Heading \d?|Title here|Überschrift hier|Titre de section|Título de (?:la )?sección)\s*$",
]
WORD_HINTS = (
    "undefined undefined|nan |[object object]|null null|xxx|yyyy|jjjj|aaaa|todo|tbd|fixme|by the author|by the writer|by the owner|by the team|placeholder text|goes here|text here|content here|title here|description here|summary here|name here|"
    "replace this|remplacez ce|ersetz|reemplace este|sustituya este|einfügen|eintragen|insérez|inserte|escriba|# section heading|# heading|# überschrift|# titre|# título"
).split("|")


def _either(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def unfilled(p: Column, low: Column) -> Column:
    """Whether prose (*low* in lower case) holds a placeholder. Signs are sought behind their first character only, words only where a plain substring hints at one."""
    signs = p.rlike(r"(?=[{<\[$#_%])(?:" + _either(PLACEHOLDER_SIGNS) + ")")
    hinted = F.lit(False)
    for h in WORD_HINTS:
        hinted = hinted | F.contains(low, F.lit(h))
    return signs | F.when(hinted, p.rlike(_either(PLACEHOLDER_WORDS))).otherwise(F.lit(False))


def prose(text: Column) -> Column:
    """A text without code (fenced, inline, comments) and quoted examples."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\z)", " ")
    t = F.regexp_replace(t, r"``[^\n]{0,400}?``|`[^`\n]{1,400}`", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:// |# TODO\(|/\*|\$ |>>> )[^\n]*$|^(?: {4}|\t)[^\n]*$", " ")
    return F.regexp_replace(t, r"[\"“„«][^\"“”»\n]{1,120}[\"”“»]", " ")


def body(text: Column) -> Column:
    """A text without byte-order mark, navigation lines and outer white space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"﻿|\r", "")
    t = F.regexp_replace(t, r"(?m)^[^\n|]{1,40}(?:\|[^\n|]{1,40}){2,}$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def masked(b: Column) -> Column:
    """A body with its numbers, ids and hosts masked; copies of one template come out equal."""
    t = F.lower(b)
    t = F.regexp_replace(t, HOST, "@")
    t = F.regexp_replace(t, r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", "#")
    return F.regexp_replace(F.regexp_replace(t, r"\d+", "0"), r"\s+", " ")


def examined(documents: DataFrame) -> DataFrame:
    """Per doc_id the evidence: whether a short body with notice terms shares no term with its address
    or title, the digest of its masked form, its notice terms, and placeholders and filler in its prose."""
    d = documents.where("doc_id is not null").select("doc_id", "text", "source")
    d = d.withColumn("prose", prose(F.col("text"))).withColumn("body", body(F.col("text")))
    d = d.withColumn("n_words", F.size(F.regexp_extract_all("body", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).withColumn("short", F.col("n_words").between(2, SHORT_WORDS))
    d = d.withColumn("low_prose", F.lower("prose"))
    d = d.withColumn("low", F.when(F.col("short"), F.lower("body")))
    # Address slug and title against the terms of the body.
    slug = F.filter(F.split(F.lower(F.coalesce("source", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    d = d.withColumn("heading", F.regexp_extract("low", r"(?m)^#+ ([^\n]+)$", 1))
    title = F.filter(F.split("heading", r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    rest = F.regexp_replace("low", r"(?m)^#+ [^\n]+$", "")
    d = d.withColumn("mismatched", F.col("short") & ~F.exists(slug, lambda w: F.contains(F.col("low"), w)) & ~F.exists(title, lambda w: F.contains(rest, w)))
    said = lambda ps: F.when(F.col("short"), F.size(F.filter(F.array(*[F.col("low").rlike("(?m)" + p) for p in ps]), lambda x: x))).otherwise(0)
    d = d.withColumn("strong", said(NOTICE_STRONG))
    d = d.withColumn("terms", F.when((F.col("strong") > 0) | F.col("mismatched"), F.col("strong") + said(NOTICE_WEAK)).otherwise(0))
    # A page that kept a title of its own, or speaks about notices, has its content; the name of a host says nothing.
    # Of a title among the evidence no word may be left over but those of notices.
    own_title = (F.col("heading") != "") & ~F.col("heading").rlike("(?m)" + _either(NOTICE_STRONG + NOTICE_WEAK))
    left_over = F.regexp_replace("heading", "(?m)(?:" + _either(NOTICE_STRONG + NOTICE_WEAK) + r")(?!\p{L})", " ").rlike(r"\p{L}{4}")
    real = F.regexp_replace("low", HOST, "@").rlike("(?m)" + SUBJECT) | (F.col("terms") < NOTICE_DENSITY * F.col("n_words"))
    d = d.withColumn("notice_terms", F.when((F.col("terms") > 0) & ~(own_title | real), F.col("terms")).otherwise(0))
    d = d.withColumn("mismatched", F.col("mismatched") & (F.col("notice_terms") > 0) & ~left_over)
    filler = F.lit(rf"\b(?:{FILLER})\b")
    dense = F.exists(
        F.split("low_prose", r"\n"),
        lambda ln: F.size(F.regexp_extract_all(ln, filler, F.lit(0))) >= F.greatest(F.lit(FILLER_WORDS), FILLER_SHARE * F.size(F.split(ln, r"\s+"))),
    )
    return d.select(
        "doc_id",
        "source",
        "strong",
        "notice_terms",
        "mismatched",
        F.when(F.col("mismatched"), F.md5(masked(F.col("body")))).alias("form"),
        unfilled(F.col("prose"), F.col("low_prose")).alias("placeholder"),
        F.when(F.contains("low_prose", F.lit("lorem")) | F.contains("low_prose", F.lit("ipsum")), dense).otherwise(F.lit(False)).alias("filler"),
    )


def judge(documents: DataFrame) -> DataFrame:
    """(doc_id, reason): 'notice', 'placeholder', 'filler' or null, one row per doc_id.

    Null, empty and tiny texts (one word) are no cases. Repeated ids fold into one row.
    """
    seen = materialise(examined(documents), "examined")  # read twice: for the forms and for the verdict
    forms = seen.where("form is not null").groupBy("form").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_hosts"))
    shared = forms.where((F.col("n_docs") >= SHARED_DOCS) & (F.col("n_hosts") >= SHARED_HOSTS)).select("form", F.lit(True).alias("shared"))
    # Bodies without a form to compare meet no other; as nulls they would all meet in one task.
    d = seen.where("form is not null").join(shared, "form", "left").unionByName(seen.where("form is null").withColumn("shared", F.lit(None).cast("boolean")))
    alone = (F.col("strong") > 0) & (F.col("notice_terms") >= NOTICE_TERMS)
    notice = alone | (F.col("mismatched") & F.coalesce("shared", F.lit(False)) & (F.col("notice_terms") >= NOTICE_TERMS_SHARED))
    reason = F.when(notice, "notice").when(F.col("placeholder"), "placeholder").when(F.col("filler"), "filler")
    return d.select("doc_id", reason.alias("reason")).groupBy("doc_id").agg(F.max("reason").alias("reason"))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each document to leave out."""
    return judge(documents).where("reason is not null").select("doc_id")


def kept(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    return documents.join(found(documents), "doc_id", "left_anti")
