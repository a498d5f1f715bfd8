"""Credentials in code, configuration, commands and remarks (problem 2).

Two kinds of evidence meet. Characters per subword of a public vocabulary tell random
strings (below two characters per subword) from words (four and more). Context tells
what a string may be. They are combined in two ways:

* Every run of token characters, wherever it stands, that the vocabulary finds
  unnatural is a candidate. Context then vetoes it (digests, commit and request ids,
  embedded data, public keys, addresses, package versions) or confirms it (a word for a
  credential before it on its line lets shorter runs count). Without the evidence of the
  vocabulary no such run is looked at.
* Where the syntax names a credential (assignments, headers, connection strings, command
  options, remarks) a value counts if it looks like one; the weaker the context, the
  stranger the string must be, as passwords people choose are made of words.

A coarse filter in the JVM keeps rows that hold neither away from Python. Redaction
masks each span with as many '*' as it has characters, so all offsets outside stay as
they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tokens import DEFAULT_DIR, chars_per_subword

#: Where capture cut a command off; a credential may end there.
CUT = 100
#: Strings with fewer characters per subword are unnatural; words and identifiers have more.
UNNATURAL = 2.9
#: A string of letters and digits may be made of words, with fewer characters per subword than this.
WORDY = 7.0
#: The bounds for runs from anywhere, with a word for a credential before them and without. Calibrated on the words and
#: identifiers of eight characters or more in turns (one in twenty is below 2.4, one in a hundred below 1.83) and on random
#: strings of letters and digits (99.9 of 100 are below 1.78).
STRANGE, STRANGER = 2.4, 1.8
#: Characters such a run must have, with and without a word for a credential; how far before it the word may stand.
CONFIRMED_LENGTH, BARE_LENGTH, REACH = 12, 20, 80

# Commands whose options carry a password: -p value, and -u or --user name:value.
_P_COMMAND = r"\b(?:mysql|mysqldump|mysqladmin|mariadb|mongo|mongosh|mongodump|sshpass)\b[^\n|;&]*?"
_U_COMMAND = r"\b(?:curl|wget|http|https|svn|ldapsearch)\b[^\n|;]*?"
#: What no credential can stand without; wider than every rule below, also where Java's \s and \w know only ASCII.
HINT = (
    r"(?i)pass|pwd|pw|secret|token|key|auth|bearer|basic\W|login|cred|PRIVATE KEY|://[^\s/@:]*:[^\s/]|://[^\s/:@]{16,}@"
    + rf"|{_P_COMMAND}\W-p|{_U_COMMAND}\W(?:-u|--user)[ =]?[^\s:]+:"
    + r"|(?<![\w+/=.@:-])(?=[A-Za-z_+/-]{0,40}\d)[\w+/=-]{20}"
    + r"|\beyJ|[?&]sig|AKIA|ASIA|gh[pousr]_|github_pat_|npm_|glpat-|xox[abopsr]-|AIza|\bsk-|-----BEGIN"
)

_KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----.*?(?:-----END \1-----|\Z)", re.S)
_JWT = re.compile(r"(?<![\w.-])eyJ[\w-]{5,}(?:\.[\w-]*){0,2}")
# Published prefixes of access tokens and key ids.
_KNOWN = re.compile(
    r"(?<![\w-])(?:(?:AKIA|ASIA)[0-9A-Z]{8,}|gh[pousr]_[A-Za-z0-9]{12,}|github_pat_\w{20,}|glpat-[\w-]{12,}|xox[abopsr]-[\w-]{12,}|AIza[\w-]{16,}|sk-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{20,})"
)
_CRED = r"(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credentials?|cred|(?:api|access|auth|secret|private|signing|deploy|service|account|encryption|master|shared)[_.\- ]?key(?:[_.\-]?id)?|key|key[_.\-]?id|apikey|auth)"
_ASSIGN = re.compile(
    r"(?<![A-Za-z0-9_.$%{-])(?P<name>[A-Za-z0-9_.\-]*?" + _CRED + r")[\"']?\s{0,3}(?::=|=>|[=:])[ \t]{0,3}(?:[frbu]?(?P<q>[\"'`])(?P<quoted>[^\"'`\n]*)(?:(?P=q)|$|(?=\n))|(?P<bare>[^\s\"'`,;&<>()\[\]{}|]+))",
    re.I,
)
_STRONG_NAME = re.compile(r"(?i)pass|pwd|secret|token|cred|api|access|auth|private|signing|_key$|-key$|[a-z0-9]Key$|pw$")
_NAME_VALUE = re.compile(r"(?i)(?:name|key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_.\-]*" + _CRED + r"[\"']?,?\s+[\"']?value[\"']?\s*[:=]\s*(?P<q>[\"']?)(?P<v>[^\"'\s>]+)")
_HEADER = re.compile(r"(?i)\b(?P<kind>bearer|basic|authorization[\"']?\s*[:=,]\s*[\"']?token)\s+(?P<v>[^\s\"'`,;&<>()\[\]{}|]+)")
_URL = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s:/@\"'<>{}$]*:(?P<v>[^\s@\"'<>{}/]+)@")
_URL_CUT = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s:/@\"'<>{}$]+:(?P<v>[^\s@\"'<>{}/]+)\Z")
_URL_USER = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://(?P<v>[^\s:/@\"'<>{}$]{16,})@")
_PARAM = re.compile(r"(?i)[?&](?:[a-z_]*(?:key|token|secret|password|passwd|pwd|pass|auth)|sig|signature)=(?P<v>[^\s&\"'<>#{}$]+)")
_OPTION = re.compile(r"(?i)(?:--?(?:api-?key|password|passwd|pass|pwd|token|secret|auth-token|access-token|access-key|secret-key|client-secret|auth|credentials?)(?:=|\s+))(?P<q>[\"']?)(?P<v>[^\s\"']+)")
_CLI_P = re.compile(_P_COMMAND + r"\s-p\s?(?P<q>[\"']?)(?P<v>[^\s\"']+)")
_CLI_U = re.compile(_U_COMMAND + r"\s(?:-u|--user)[ =]?[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)")
_NETRC = re.compile(r"(?im)(?:^|[\s;])(?:password|passwd|passphrase)[ \t]+(?P<v>[^\s\"'`]+)")
_REMARKS = [
    re.compile(p, re.I)
    for p in (
        r"\b(?:use|try|take|set)\s+[`\"']?(?P<v>[^\s`\"']+)[`\"']?\s+(?:as|for)\s+(?:the\s+)?(?:\w+\s+){0,2}(?:key|token|password|passwd|pw|secret|login|credential)",
        r"\b(?:password|passwd|pwd|pw|passphrase|secret|token|key|login|credentials?|creds?)\b(?:\s+(?:for|of|on|to|in)\s+\S+){0,3}\s*(?:is|was|are|=|:|->)\s*[`\"']?(?P<v>[^\s`\"']+)",
        r"\b(?:with|using|via)\s+(?:the\s+)?(?:api\s+)?(?:password|token|key|secret|pw|login)\s+[`\"']?(?P<v>[^\s`\"']+)",
        r"(?:password|token|key|secret|cred|login|auth)\w*[^\n]*?(?://|#|--|/\*)\s*(?:\w+\s+){0,2}(?:was|old|previously|formerly|used to be)[ :]+[`\"']?(?P<v>[^\s`\"']+)",
    )
]
# Values that stand for a credential and are none.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[\W_]*$|x{4,}$|<|\$|%|\{|\[|your[_-]|my[_-]|(?:your|change[_-]?(?:me|it)|example|sample|placeholder|dummy|redacted|masked|hidden|secret|password|passwd|pass|token|none|null|nil|true|false|undefined|todo|tbd|n/?a)\d{0,3}$|"
    r"(?:os|process|env|config|settings|vault|self|ctx|secrets|app|req|request|this|options|opts|args|params|conf|cfg|ssm|kms|op|aws-?sm)[.:\[(/]|[rcs][.\[(]|arn:|ref\+|\./|~/|file:|https?:)"
)
_TRAIL = ".,:;"

# Runs of token characters; what makes one no candidate by itself; what stands before one that is something else.
_RUN = re.compile(r"(?<![\w+/=.@:~-])[\w+/=~-]{12,}(?![\w@]|\.\w|://)")
_HARMLESS = re.compile(r"(?i)(?:sha\d+-.*|[0-9a-f]+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d[\d_-]*|[A-Z]{1,3}-\d[\d-]*|0x[0-9a-f]+|.*=(?:[0-9a-f]{8}-.*|[0-9a-f]+))")
_ELSE = re.compile(
    r"(?i)(?:sha-?\d*|md5|crc\d*|e-?tag|integrity|digest|checksum|hash|fingerprint|commit|revision|rev|ref|tree|parent|blob|uuid|guid|build|version|image|base64|data"
    r"|(?:request|trace|span|correlation|session|event|message|order|job|run|ticket|customer|user|account|device|client|tenant|object)[_ .-]?id|\bid|cursor|nonce|etag|ssh-\w+|ecdsa-\S+)[\"']?\s*[-:=,#]?\s*[\"'`(<]?$"
)
_WORD_FOR_IT = re.compile(r"(?i)pass(?:word|wd|phrase|code)?\b|pwd|secret|token|api|credential|cred\b|login|auth|bearer|\bkeys?\b|[_-]key\b|[a-z]Key\b")
_PUBLIC = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:PUBLIC KEY|CERTIFICATE|SIGNATURE|MESSAGE)[A-Z0-9 ]*-----.*?(?:-----END|\Z)|\bdata:[\w./+-]*;base64,\S*|\bssh-\w+ \S+", re.S)


def _strange(text: str, folder: str) -> Iterator[tuple[int, int]]:
    """Runs the vocabulary finds unnatural and context does not explain otherwise."""
    public = None
    for m in _RUN.finditer(text):
        v = m[0].rstrip("=") if m[0].count("=") and not m[0].rstrip("=").count("=") else m[0]
        if not any(c.isdigit() for c in v) or not any(c.isalpha() for c in v) or _HARMLESS.fullmatch(v) or "=" in v:
            continue
        if "/" in v and sum(len(p) > 3 and p.isalpha() for p in v.split("/")) > 0:  # a path
            continue
        score = chars_per_subword(v, folder)
        if score >= STRANGE:
            continue
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()][-REACH:]
        if _ELSE.search(line):
            continue
        mixed = any(c.islower() for c in v) + any(c.isupper() for c in v) + 1 > 2
        if _WORD_FOR_IT.search(line):
            if not mixed:
                continue
        elif not (mixed and score < STRANGER and len(v) >= BARE_LENGTH):
            continue
        if public is None:
            public = [x.span() for x in _PUBLIC.finditer(text)]
        if all(m.end() <= a or m.start() >= b for a, b in public):
            yield m.start(), m.start() + len(v)


def _credential_like(v: str, strength: int, folder: str, at_cut: bool = False) -> bool:
    """Whether a string in a credential context looks like one; strength 3 (strong) to 1 (a remark)."""
    if not v or _PLACEHOLDER.match(v) or "(" in v or "{{" in v or "${" in v:
        return False
    if at_cut:
        return strength >= 2 and not v.isdigit()
    digits, letters = sum(c.isdigit() for c in v), sum(c.isalpha() for c in v)
    special = any(not c.isalnum() and c not in "_-./" for c in v)
    if not letters or len(v) < 6:
        return bool(strength == 3 and len(v) >= 6 and special)
    cps = chars_per_subword(v, folder)
    if v[0] == "/" and cps >= 2.5:  # a path
        return False
    if re.fullmatch(r"[A-Za-z_\-]*(?:key|token|secret|password|passwd|pwd)s?", v, re.I):
        return False
    if strength == 3:
        return (digits > 0 and len(v) >= 6) or special or (cps < UNNATURAL and len(v) >= 8)
    if strength == 2:
        return len(v) >= 8 and ((digits > 0 and (cps < WORDY or special)) or (special and cps < UNNATURAL) or (cps < UNNATURAL and len(v) >= 12))
    return len(v) >= 8 and ((digits > 0 and cps < WORDY) or (special and cps < UNNATURAL) or (cps < 2.4 and len(v) >= 12))


def spans(text: str | None, folder: str = DEFAULT_DIR, cut: bool = False) -> list[tuple[int, int]]:
    """The (start, end) of each credential of *text*, in order, without overlap.

    Null and empty texts have none. With *cut*, a text of CUT characters may end inside
    a credential, whose rest counts. Texts are read whole, whatever their length.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    ends = len(text) if cut and len(text) >= CUT else -1

    def add(m: re.Match, group: str | int, rank: int, strength: int) -> None:
        a, b = m.span(group)
        if a < 0:
            return
        v = text[a:b]
        while v and v[-1] in _TRAIL and b != ends:
            v, b = v[:-1], b - 1
        if v and (strength == 9 or _credential_like(v, strength, folder, b == ends)):
            found.append((rank, a, b))

    for m in _KEY_BLOCK.finditer(text):
        add(m, 0, 0, 9)
    for m in _JWT.finditer(text):
        add(m, 0, 1, 3)
    for m in _PARAM.finditer(text):
        add(m, "v", 2, 3)
    for m in _URL.finditer(text):
        add(m, "v", 2, 3)
    if ends > 0:
        for m in _URL_CUT.finditer(text):
            add(m, "v", 2, 3)
    for m in _URL_USER.finditer(text):
        add(m, "v", 2, 2)
    for m in _KNOWN.finditer(text):
        add(m, 0, 3, 3)
    for m in _HEADER.finditer(text):
        add(m, "v", 3, 2 if m["kind"].lower() == "basic" else 3)
    for m in _ASSIGN.finditer(text):
        strong = 3 if _STRONG_NAME.search(m["name"]) else 2
        add(m, "quoted" if m["quoted"] is not None else "bare", 4, strong)
    for m in _NAME_VALUE.finditer(text):
        add(m, "v", 4, 3)
    for pattern, strength in ((_OPTION, 3), (_CLI_P, 3), (_CLI_U, 3), (_NETRC, 2)):
        for m in pattern.finditer(text):
            add(m, "v", 5, strength)
    for pattern in _REMARKS:
        for m in pattern.finditer(text):
            add(m, "v", 6, 1)
    for a, b in _strange(text, folder):
        found.append((7, a, b))
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(found):
        if all(b <= x or a >= y for x, y in out):
            out.append((a, b))
    return sorted(out)


def _mask(text: str, at: list[tuple[int, int]]) -> str:
    parts, last = [], 0
    for a, b in at:
        parts += [text[last:a], re.sub(r"[^\n\r]", "*", text[a:b])]
        last = b
    return "".join([*parts, text[last:]])


def detect(rows: DataFrame, id_col: str, text_col: str, cut: bool = False, tokenizer_dir: str = DEFAULT_DIR) -> DataFrame:
    """(row_id, start, secret, masked) per credential; ``masked`` is the whole redacted text, on the first only.

    Rows without a credential give none; neither do null ids. Extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row_id, text in zip(b["row_id"], b["text"]):
                at = spans(text, tokenizer_dir, cut)
                for i, (x, y) in enumerate(at):
                    out.append((row_id, x, text[x:y], _mask(text, at) if i == 0 else None))
            yield pd.DataFrame(out, columns=["row_id", "start", "secret", "masked"])

    hinted = rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).where(F.col("row_id").isNotNull() & F.col("text").rlike(HINT))
    return hinted.mapInPandas(run, "row_id string, start int, secret string, masked string")


def found(turns: DataFrame, tool_calls: DataFrame, tokenizer_dir: str = DEFAULT_DIR) -> DataFrame:
    """(src, row_id, secret) of both tables, distinct."""
    a = detect(turns, "id", "content", tokenizer_dir=tokenizer_dir).select(F.lit("turns").alias("src"), "row_id", "secret")
    b = detect(tool_calls, "id", "cmd_prefix", True, tokenizer_dir).select(F.lit("tool_calls").alias("src"), "row_id", "secret")
    return a.unionByName(b).distinct()


def redact(rows: DataFrame, id_col: str, text_col: str, cut: bool = False, tokenizer_dir: str = DEFAULT_DIR) -> DataFrame:
    """All rows, (row_id, text, n_secrets): each credential masked in place, all else as it was.

    Repeated rows stay repeated; null text stays null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [spans(t, tokenizer_dir, cut) if h else [] for t, h in zip(b["text"], b["hint"])]
            yield pd.DataFrame({"row_id": b["row_id"], "text": [_mask(t, s) if s else t for t, s in zip(b["text"], at)], "n_secrets": [len(s) for s in at]})

    hinted = rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).withColumn("hint", F.coalesce(F.col("text").rlike(HINT), F.lit(False)))
    return hinted.mapInPandas(run, "row_id string, text string, n_secrets int")
