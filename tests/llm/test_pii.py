import pytest

from threadloom.llm import pii

TEXTS = {
    "mail": ("Please add anna.muster+x@example.org.", {("email", "anna.muster+x@example.org")}),
    "mail_at": ("From: Nora Feldstern <nora (at) mail.test.example> hi", {("email", "nora (at) mail.test.example"), ("name", "Nora Feldstern")}),
    "login": ("ssh deploy@queue.example -p 22 and git@code.test:team/x.git and redis://u:p@h.example/0 npm i @a/b@1.2.3", set()),
    "phones": ("call +49 30 23125 416. or (415) 555-0116 x 415.555.0153, 0491 570 157; +33 1 99 00 23 76", {("phone", p) for p in ("+49 30 23125 416", "(415) 555-0116", "415.555.0153", "0491 570 157", "+33 1 99 00 23 76")}),
    "no_phones": ("rate is 1.872.139 per hour, ticket 648-77-9841, build 4.18.109.2688, 2025-05-21 09:47, port 16252", set()),
    "ids": ("SSN 959-15-5744, Steuer-ID: 07 096 560 236, DNI 99172247L, NINO=QQ265902C, passport no. ZK2237310, driver licence X-3455-7196", {("id_number", x) for x in ("959-15-5744", "07 096 560 236", "99172247L", "QQ265902C", "ZK2237310", "X-3455-7196")}),
    "streets": ("to 118A Brindle Court, Am Kiefernhang 53. Calle del Olmo Viejo, 12; Eschenbrückstraße 9 and 31 Session Lane workers", {("address", a) for a in ("118A Brindle Court", "Am Kiefernhang 53", "Calle del Olmo Viejo, 12", "Eschenbrückstraße 9")}),
    "fr1": ("Office: 12, rue des Ormeaux The next", {("address", "12, rue des Ormeaux")}),
    "fr2": ("Office: 14, rue des Ormeaux.", {("address", "14, rue des Ormeaux")}),
    "fr3": ("Office: 15, rue des Ormeaux", {("address", "15, rue des Ormeaux")}),
    "fr4": ("at 3, rue du Vieux Lavoir.", {("address", "3, rue du Vieux Lavoir")}),
    "fr5": ("at 4, rue du Vieux Lavoir'", {("address", "4, rue du Vieux Lavoir")}),
    "seed1": ("Co-authored-by: Emil van der Berg <e@example.org>", {("email", "e@example.org"), ("name", "Emil van der Berg")}),
    "low": ("emil van der berg asked, then FELDSTERN Nora and Feldstern, Nora too", {("name", "emil van der berg"), ("name", "FELDSTERN Nora"), ("name", "Feldstern, Nora")}),
    "single": ("Emil said so. Project Marlin and Team Osprey share the job.", set()),
    "null": (None, set()),
    "empty": ("", set()),
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(k, t, "x") for k, (t, _) in TEXTS.items()]
    return spark.createDataFrame(rows + rows[:3] + [(None, "a@example.org", "x")], "id string, content string, kind string")


def test_found(turns):
    want = {(k, kind, v) for k, (_, found) in TEXTS.items() for kind, v in found}
    got = [tuple(r) for r in pii.found(turns).collect()]
    assert set(got) == want and len(got) == len(want)


def test_sanitise(turns):
    got = {r.turn_id: r.content for r in pii.sanitise(turns).collect()}
    assert set(got) == set(TEXTS)
    assert got["seed1"] == "Co-authored-by: <NAME> <<EMAIL>>" and got["mail"] == "Please add <EMAIL>." and got["null"] is None
    assert got["no_phones"] == TEXTS["no_phones"][0]


def test_empty(spark):
    none = spark.createDataFrame([], "id string, content string")
    assert pii.found(none).count() == 0 and pii.sanitise(none).count() == 0


def test_long_text(spark):
    long = "plain words here " * 20000 + "mail z.y@example.org end"
    assert [tuple(r) for r in pii.found(spark.createDataFrame([("a", long)], "id string, content string")).collect()] == [("a", "email", "z.y@example.org")]


def test_placeholders_at_their_places_and_lone_terms(spark):
    rows = [(f"s{i}", f"From: Nora Feldstern <n{i}@example.org> hi") for i in range(6)] + [(f"t{i}", f"Will Osterkamp <w{i}@example.org> wrote") for i in range(3)]
    rows += [
        ("whole", "Nora Feldstern and Nora Feldsternhof met"), ("lone", "Nora said Feldstern is away, NORA's file src/nora.go stays"),
        ("other", "nobody knows; 12345 Nora-Feldsterns"), ("same", "mail a.b@example.org, not xa.b@example.org.uk or 1a.b@example.org"),
    ] + [(f"w{i}", f"We will see, will it run {i} times?") for i in range(40)]
    got = {r.turn_id: r.content for r in pii.sanitise(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert len(got) == len(rows) and got["s0"] == "From: <NAME> <<EMAIL>> hi"
    assert got["whole"] == "<NAME> and <NAME> Feldsternhof met"
    assert got["lone"] == "<NAME> said <NAME> is away, NORA's file src/nora.go stays"
    assert got["other"] == "nobody knows; 12345 Nora-Feldsterns" and got["same"] == "mail <EMAIL>, not <EMAIL> or <EMAIL>"
    # "Will" stands beside an address three times and elsewhere forty times: it tells too little.
    assert got["t0"] == "Will Osterkamp <<EMAIL>> wrote" and got["w7"] == "We will see, will it run 7 times?"
