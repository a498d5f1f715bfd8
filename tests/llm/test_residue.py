import pytest

from threadloom.llm import residue

CASES = {
    "notice": [
        "404 Not Found\n\nThe page you requested could not be found on this server.\nRequest ID: ab12cd34",
        "docs | home | search\nPlease enable JavaScript to view this page. Your browser does not run scripts or they are blocked.",
        "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
        "Página no encontrada. Error 404. Vuelva a la página de inicio.",
        "Access denied. You do not have permission to view this document. Reference #8e17",
        "Too many requests. Slow down and retry after 30 s.",
        '{"error": {"code": 500, "message": "upstream timed out"}}',
    ],
    "placeholder": [
        "Real text here.\n\nWelcome to {{ team }}, maintained by {{owner}}.\n\nMore.",
        "Intro\nContact <your name> at <your team> for access.",
        "The ${project.owner} service starts first.",
        "Description: TODO: describe what this component does",
        "Owner: undefined undefined. Updated NaN days ago.",
        "Version: [[version]] of [[owner]]\r\nmore",
        "Sehr geehrte/r {Anrede} {Nachname}, der Export ist fertig.",
        "## Section heading\n\nPlaceholder text, to be replaced by the author.",
    ],
    "filler": ["# Title\n\nLorem ipsum dolor sit amet labore elit magna aliqua veniam tempor.\n\nReal text follows."],
    None: [
        None, "", " ", "ok", "n/a", "see above",
        "# Retry\n\nReturn a 404 when the anchor is missing, and log the path.",
        "# Pages\n\nThe page shows a notice when JavaScript is disabled; the test checks that it appears after 9 ms.",
        "A placeholder such as `{{ name }}` is replaced by the prompt builder before sending.",
        "The chart template writes the release name:\n```yaml\nname: {{ .Release.Name }}-x\n```\nDone.",
        "In the shell script:\n```sh\nout=\"${A}/b\"\n```",
        "# TODO(cursor): drop this branch after the upgrade",
        "Session handling and retry of the server were reviewed; permission checks stay.",
        "```\n<%= unfinished %>",
    ],
}


def rows():
    flat = [(t, want) for want, ts in CASES.items() for t in ts]
    return [(i, t, f"host-{i % 5}", want) for i, (t, want) in enumerate(flat)]


def test_reasons(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s, _ in data] + [(0, data[0][1], "host-0", "x")], "doc_id bigint, text string, source string, reason string")
    got = {r.doc_id: r.reason for r in residue.judge(df).collect()}
    assert {(data[i][1], got[i]) for i in got} == {(t, want) for _, t, _, want in data}
    assert {r.doc_id for r in residue.found(df).collect()} == {i for i, _, _, w in data if w}
    assert residue.kept(df).count() == sum(w is None for *_, w in data)


#: Only their coming back under other addresses tells the first ones; the others come back too and are none.
SHARED = ["Signed out. Sign in again.", "Veuillez recharger plus tard ({}).", "Disabled, retry in {} seconds."]
NEVER = ["Human: please retry the gateway step {}.", "# Retry queue\n\nThe server waits {} s.", "step {} of the plan is done and nobody read it", "The test checks that the browser shows notice {}.", "{}"]


def test_a_host_name_is_no_subject(spark):
    rows = [(1, "You need to turn on scripts and cookies to continue to hooks.tidewell.test.", "a"), (2, "You need to turn on scripts and cookies in the test of the page.", "b")]
    assert [r.doc_id for r in residue.found(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()] == [1]


def test_host_evidence_decides(spark):
    schema = "doc_id bigint, text string, source string"
    rows = [(100 * k + i, t.format(11 + i), f"{chr(97 + i) * 4}-pocket") for k, t in enumerate(SHARED + NEVER) for i in range(4)]
    of = lambda rs: {r.doc_id for r in residue.found(spark.createDataFrame(rs, schema)).collect()}
    want = {i for i, _, _ in rows if i < 100 * len(SHARED)}
    assert of(rows) == want
    # One copy each, copies under one address, or under addresses that name the text's subject: no evidence.
    assert of(rows[::4]) == set()
    assert of([(i, t, "one") for i, t, _ in rows]) == set()
    assert of([(i, t, t.split()[0].strip(".,") if i < 300 else s) for i, t, s in rows]) == set()


@pytest.mark.parametrize("text", ["word " * 40000, "{" * 50000, "`" * 30001, "<" * 20000 + "%>"])
def test_long_texts(spark, text):
    assert residue.judge(spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, source string")).count() == 1


def test_empty(spark):
    assert residue.found(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
