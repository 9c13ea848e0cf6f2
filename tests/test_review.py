from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyward.functions import names as N
from tallyward.functions import vocab as V
from tallyward.functions.dates import age_days, conventions, day_of, extraction_day
from tallyward.operators import cycles, people, reports, review

REF = date(2026, 7, 1)


def frame(spark, columns, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns.split()))


def run(spark, columns, *rows, **how):
    return review.analyse(frame(spark, columns, *rows), review.Settings(REF, **how)).collect()


def test_departed_but_active_is_revoked(spark):
    r = run(spark, "username system account_status employee_status last_login_date", ("jd", "ERP", "Active", "Terminated", "2026-06-20"))[0]
    assert r.is_terminated_but_active and r.review_action == V.ACTIONS["revoke"] and r.risk_level == "Critique" and r.risk_score == 50


@pytest.mark.parametrize(("login", "dormant"), [("2026-04-02", False), ("2026-04-01", True), ("2026-06-30", False), ("garbage", True), ("never", False)])
def test_dormant_at_the_edge(spark, login, dormant):
    assert run(spark, "username system last_login_date", ("a", "s", login))[0].is_dormant is dormant


def test_missing_columns_switch_controls_off(spark):
    r = run(spark, "username system", ("jd", "ERP"))[0]
    assert not r.is_dormant and not r.is_never_used and not r.is_password_stale and r.review_action == V.ACTIONS["none"] and r.risk_score == 0


def test_statuses(spark):
    want = {"1": (True, False), "-1": (True, True), "0": (False, False), "Y-Active": (True, False), "N-inactive": (False, False), "Not Active": (True, True), "LOCKED": (False, False), "": (True, False), None: (True, False), "???": (True, True), "+01": (True, False)}
    df = frame(spark, "account_status", *[(k,) for k in want])
    got = {r.account_status: (r.s.active, r.s.unknown) for r in df.withColumn("s", review.status(df.account_status)).collect()}
    assert got == want


def test_locked_and_unlocked(spark):
    rows = run(spark, "username system account_status is_locked", ("a", "s", "Locked", None), ("b", "s", "Unlocked", None), ("c", "s", "Déverrouillé", None), ("d", "s", "Active", "1"), ("e", "s", "Bloqué", "0"))
    assert {r.username: r.is_locked for r in rows} == {"a": True, "b": False, "c": False, "d": True, "e": True}


def test_passwords_of_people_and_services(spark):
    rows = run(spark, "username system password_last_set", ("a", "s", "2026-03-01"), ("svc_x", "s", "2026-03-01"), ("svc_y", "s", "2025-03-01"), ("b", "s", None), ("c", "s", "2026-06-01"))
    assert {r.username: r.is_password_stale for r in rows} == {"a": True, "svc_x": False, "svc_y": True, "b": True, "c": False}
    assert {r.username for r in rows if r.review_action == V.ACTIONS["ask_owner_password"]} == {"svc_y"}


def test_privileges_from_every_source(spark):
    rows = run(spark, "username system is_privileged role user_rights", ("a", "s", "Yes", None, None), ("b", "s", None, "Clerk;Administrator", None), ("c", "s", None, "Administrative Assistant", None), ("d", "s", None, None, "WRITE_ALL"), ("j.admin", "s", None, None, None), ("cadmium", "s", None, None, None), ("e", "s", None, "Lead, power user", None), rights={"WRITE_ALL": "admin"})
    assert {r.username: r.is_privileged_flag for r in rows} == {"a": True, "b": True, "c": False, "d": True, "j.admin": True, "cadmium": False, "e": True}


def test_duplicates_need_a_real_name_and_two_logins(spark):
    rows = run(spark, "username system full_name account_status", ("a", "s", "Ann Lee", "Active"), ("b", "S ", " ann lee", "Active"), ("c", "t", "Ann Lee", "Active"), ("d", "s", "Bo", "Active"), ("D", "s", "Bo", "Active"), ("e", "s", "N/A", "Active"), ("f", "s", "N/A", "Active"), ("g", "s", "Cy", "Disabled"), ("h", "s", "Cy", "Active"))
    assert {r.username for r in rows if r.is_duplicate_account} == {"a", "b"}


DATES = {
    "2026-06-01": 30, "2026-06-01T14:30:00.0000000+02:00": 30, "01/06/2026": 30, "1.6.2026 08:15": 30, "20260601": 30, "46174": 30, "1780272000": 30, "1780272000000": 30,
    "134247456000000000": 30, "20260601143000Z": 30, "20260601143000.0+0100": 30, "01-Jun-26 05.13.24.623000 AM": 30, "1st June 2026": 30, "June 1, 2026": 30, "Mon, 01 Jun 2026 14:30:00 +0100": 30,
    "Jun  1 14:30:06 +0100 2026": 30, "1 juin 2026": 30, "01 giugno 2026": 30, "25/05/2026": 37, "05/25/2026": 37, "31/02/2026": None, "4 20:09:01 +0000 2025": None, "12,01,2026": None, "1970-01-01": None,
    "never": None, "": None, None: None, "12345": None, "20261345": None, "word": None,
    "2026-06-01 garbage": None, "2026-06-01zzz": None, "01/06/2026x": None, "2026-06-01 25:10": None, "1 June 2026 or so": None, "2026-06-01Z": 30, "2026-06-01 +01:00": 30, "2026-06-01 14:30:00 CET": 30,
    "2026-06-01 14:30:00 +01:00 (CET)": 30, "01/06/2026 2:15 pm": 30, "01.06.26 14.30.00": 30, "05Jan2026": 177, "2026 Jun 1": 30, "2026-Jun-01": 30, "Jun/01/2026": 30, "juin 2026": 30, "2026-06": 30, "06/2026": 30,
    "Mon Jun 1 16:05": 30, "1 June": 30, "Jul 2 08:00": 364, "Feb 29 10:00": 853, "Mon Foo 1 16:05": None,
}


def test_dates_of_all_kinds(spark):
    df = frame(spark, "d", *[(k,) for k in DATES])
    got = {r.d: r.a for r in df.withColumn("a", age_days("d", REF)).collect()}
    assert got == DATES


def test_conventions(spark):
    df = frame(spark, "a b c d", ("25/03/2026", "03/25/2026", "03/04/2026", "26-01-45"), ("03/25/2026", "03/04/2026", None, "99-02-10"))
    got = {r.column_name: (r.day_first, r.year_first, r.convention) for r in conventions(df, ["a", "b", "c", "d"]).collect()}
    assert got["a"] == (True, False, "mixed") and got["b"][0] is False and got["c"] == (True, False, "guessed")
    mixed = frame(spark, "x", ("25/03/2026",), ("03/25/2026",), ("03/04/2026",))
    days = [r.d for r in mixed.select(day_of("x", REF, convention="mixed").alias("d")).collect()]
    assert days == [date(2026, 3, 25), date(2026, 3, 25), None]


@pytest.mark.parametrize(("a", "b", "same"), [
    ("J. Dupont", "Jean Dupont", True), ("jdupont", "Jean Dupont", True), ("dupontj", "Jean Dupont", True), ("jean.dupont", "Dupont Jean", True), ("jd", "Jean Dupont", True), ("Jean Martin", "Jean Dupont", False),
    ("bba", "Juah B C. Dixon", False), ("HARMONY Z. JAYNES", "Harmony Jaynes", True), ("prince", "Prince W. Gbeaduh", True), ("jdupont_adm", "Jean Dupont", True), ("", "Jean", False), ("O'Brien Anne", "Anne Obrien", True),
])
def test_same_person(a, b, same):
    assert N.same_person(a, b) is same and N.same_person(b, a) is same


def test_meeting_keys_lose_no_pair():
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3, 4])))
    hits = 0
    for _ in range(30_000):
        a = " ".join(word() for _ in range(rng.randint(1, 4)))
        b = rng.choice([" ".join(word() for _ in range(rng.randint(1, 4))), ".".join(rng.sample(a.split(), len(a.split()))), "".join(rng.sample(a.split(), len(a.split()))), a.split()[0][0] + a.split()[-1]])
        if N.same_person(a, b):
            hits += 1
            assert set(N.meeting_keys(a, 0)) & set(N.meeting_keys(b, 1)), (a, b)
    assert hits > 3000


def test_transfers_and_hr(spark):
    acc = review.analyse(frame(spark, "username full_name system account_status", ("jdupont", "X", "s", "Active"), ("u2", "Ann Lee", "s", "Active"), ("u3", "Ann Lee", "s", "Disabled"), ("u4", "Bo Ray", "s", "Active")), review.Settings(REF))
    out = {r.username: (r.is_transferred_but_active, r.transferred_name_ambiguous) for r in people.transferred(acc, frame(spark, "full_name", ("Jean Dupont",), ("A. Lee",), ("Ann Lee",))).collect()}
    assert out == {"jdupont": (True, False), "u2": (True, True), "u3": (False, False), "u4": (False, False)}
    hr = spark.createDataFrame([(1, " JDUPONT", "Gone"), (2, "jdupont", "Here"), (3, None, "Gone")], "line_no long, hr_username string, hr_employee_status string")
    got = {r.username: (r.employee_status, r.hr_cross_referenced) for r in people.with_hr(acc, hr).collect()}
    assert got["jdupont"] == ("Gone", True) and got["u2"] == (people.UNKNOWN, False)


def test_role_conflicts_over_systems_and_by_likeness(spark):
    acc = frame(spark, "username system role", ("ann", "a", "Create Payment"), ("ANN ", "b", "Approve Payment v2"), ("bob", "a", "Create Payments;Aprove Payment"), ("cy", "a", "Viewer"))
    m = people.conflict_table(spark)
    assert {r.username for r in people.role_conflicts(acc, m, threshold=None).where("sod_conflict").collect()} == {"ann", "ANN "}
    assert N.ratio("approve payment", "Approve Payment") < 88 <= N.ratio("create payment", "create payments")
    low = frame(spark, "username system role", ("bob", "a", "create paiment;aprove payment"))
    assert people.role_conflicts(low, m).first().sod_conflict and not people.role_conflicts(low, m, threshold=99.0).first().sod_conflict


def test_quality_of_five_rows(spark):
    df = frame(spark, "username system account_status last_login_date manager", ("a", "s", "Active", "2026-01-01", "m"), ("a", "S", "Active", "2026-01-01", None), ("b", "s", "zzz", "2026-01-01", "m"), ("c", "s", "Active", "2026-01-01", "m"), ("d", "s", "Active", "never", "m"))
    r = reports.quality(df, REF).first()
    assert (r.accounts, r.copies, r.unknown_status, r.bad_rows, r.reliability, r.no_manager) == (5, 2, 1, 3, 40.0, 1)
    assert reports.quality(df.limit(0), REF).first().reliability == 0.0


def test_acceptance_removes_one_finding(spark):
    df = review.analyse(frame(spark, "username system account_status last_login_date", ("a", "s", "Active", "2025-01-01"), ("b", "s", "Active", "2025-01-01")), review.Settings(REF))
    acc = spark.createDataFrame([("A", "s", "is_dormant", "l", "c", "me", "2026-01-01", "2026-12-31", 1), ("b", "s", "is_dormant", "l", "c", "me", "2026-01-01", "2026-06-01", 1)], "username string, system string, finding string, label string, comment string, accepted_by string, accepted_date string, expiration_date string, seq long")
    out = {r.username: r for r in cycles.with_acceptances(df, acc, REF).collect()}
    assert out["a"].accepted_finding_keys == ["is_dormant"] and out["a"].review_action == V.ACTIONS["none"] and out["a"].is_dormant
    assert out["b"].expired_finding_keys == ["is_dormant"] and out["b"].review_action == V.ACTIONS["disable_dormant"]
    n = {r.number: r.found for r in reports.control_coverage(cycles.with_acceptances(df, acc, REF)).collect()}
    assert n[2] == 1 and n[5] == 2


def test_breakdown_sums_to_total(spark):
    a, b = frame(spark, "account_status", ("x",), (" ",), ("x",)), frame(spark, "account_status", ("y",), ("x",))
    rows = {r.account_status: (r.n_current, r.n_previous, r.variation) for r in reports.status_breakdown(a, b).collect()}
    assert rows == {"x": (2, 1, "+1"), "Unknown": (1, 0, "+1"), "y": (0, 1, "-1"), "TOTAL": (3, 2, "+1")}


def test_merge_or_stack(spark):
    a = frame(spark, "username role", *[(f"p{i}", "r") for i in range(8)])
    b = frame(spark, "username phone", *[(f"P{i}", "1") for i in range(4)])
    c = frame(spark, "username role", *[(f"q{i}", "r") for i in range(8)])
    out = cycles.merge_or_stack({"a": a, "c": c})
    assert out.count() == 16 and {r.system for r in out.collect()} == {"a", "c"}
    assert cycles.merge_or_stack({"a": a, "b": b}).count() == 12


def test_decisions(spark):
    log = cycles.decision(spark, "Ann", "S", 1, "approved", "me", "t1").union(cycles.decision(spark, "ann ", "s", 2, "revoked", "you", "t2"))
    out = {r.username: (r.review_status, r.validated_by) for r in cycles.latest_decisions(frame(spark, "username system", ("ANN", "s"), ("bob", "s")), log).collect()}
    assert out == {"ANN": ("revoked", "you"), "bob": ("pending", "")}
    assert [r.seq for r in cycles.audit_trail(log, "ann", "S").collect()] == [1, 2]
    with pytest.raises(ValueError, match="unknown"):
        cycles.decision(spark, "a", "s", 1, "maybe", "me", "t")


def test_extraction_day():
    for t in ("01/06/2026", " 2026-06-01", "01-06-2026", "01.06.2026"):
        assert extraction_day(t, REF) == date(2026, 6, 1)
    assert extraction_day("soon", REF) == extraction_day(None, REF) == REF


def test_expired_acceptances_and_recognised_rows(spark):
    df = spark.createDataFrame([("a", "s", ["is_dormant"], True), ("b", "s", [], False)], "username string, system string, expired_finding_keys array<string>, _ocr_source boolean")
    assert [r.findings for r in reports.with_expired_acceptances(df).collect()] == ["is_dormant"]
    assert reports.read_by_recognition(df).first().recognised == 1


def test_the_list_of_people_is_whole(spark):
    from tallyward.plans import testdata as D

    d = "/root/testdata/sf0.001"
    names = {r.full_name for r in D.accounts(spark, d).select("full_name").where("full_name is not null").distinct().collect()}
    listed = {r.full_name for r in D.view(spark, d, D.PEOPLE).collect()}
    assert {x for x in names if not x.startswith(("Greta", "Felix"))} <= listed and names - listed


def test_people_and_conflicts_agree_with_brute_force(spark):
    """Every account against every listed person, and every role against every pair, by the rules themselves."""
    import random

    rng = random.Random(8)
    first, last = ["Anna", "Boris", "A.", "Jean-Marc", "J", "Van", "Élise"], ["Moreau", "van der Berg", "O'Brien", "M.", "Li", "Quinn Rossi"]
    name = lambda: " ".join(filter(None, [rng.choice(first), rng.choice(["", "", "B.", "Maria"]), rng.choice(last)]))
    logins = ["amoreau", "anna.moreau", "bli", "jq", "elise", "moreau", "boris_adm", "x17"]
    roles = ["Create Payment", "Aprove Payment", "approve payment v2", "Create Vendors", "Viewer", "developer lead", "Production Deploy", ""]
    rows = [(rng.choice(logins) + str(rng.choice(["", "", "2"])), rng.choice([name(), name(), None]), rng.choice("st"), rng.choice(["Active", "Disabled"]), ";".join(rng.sample(roles, 2))) for _ in range(400)]
    listed = sorted({name() for _ in range(25)})
    acc = review.analyse(frame(spark, "username full_name system account_status role", *rows), review.Settings(REF)).withColumn("n", F.monotonically_increasing_id())
    got = {(r.username, r.full_name, r.account_status): (r.is_transferred_but_active, r.transferred_name_ambiguous) for r in people.transferred(acc, frame(spark, "full_name", *[(x,) for x in listed])).collect()}
    hits = 0
    for username, full_name, _, status, _ in rows:
        n = sum(N.same_person(username, x) or (full_name is not None and N.same_person(full_name, x)) for x in listed) if status == "Active" else 0
        hits += n > 0
        assert got[username, full_name, status] == (n > 0, n > 1), (username, full_name)
    assert 50 < hits < 390
    held: dict[str, set[str]] = {}
    holders = [(f"u{k % 150}", "s", r[-1]) for k, r in enumerate(rows)]
    for username, _, role in holders:
        held.setdefault(username, set()).update(x.strip() for x in role.split(";") if x.strip())
    holds = lambda role, part: part.lower() in role.lower() or N.ratio(part, role) >= 88.0
    want = {u: next((f"{a} + {b}" for a, b in V.ROLE_CONFLICTS if any(holds(r, a) for r in rs) and any(holds(r, b) for r in rs)), "") for u, rs in held.items()}
    out = people.role_conflicts(frame(spark, "username system role", *holders), people.conflict_table(spark)).select("username", "sod_conflict_detail").distinct().collect()
    assert {r.username: r.sod_conflict_detail for r in out} == want and len(set(want.values())) > 1


def test_merge_deals_logins_of_many_rows(spark, monkeypatch):
    """All pairs come out, alike rows as often as they are there, and those of one login from several tasks."""
    monkeypatch.setattr(cycles, "PAIRS", 200)
    monkeypatch.setattr(cycles, "SIDE", 8)
    left = [("h", f"S{k % 3}", "r") for k in range(30)] + [("h", "one", "same")] * 20 + [(None, "n", str(k % 2)) for k in range(21)] + [("c", "S", "x")] * 2 + [("only", None, "y")]
    right = [("h", f"T{k % 5}", str(k % 4)) for k in range(31)] + [(None, None, "q")] * 12 + [("c", "T", "z"), ("other", "T", None)]
    want = [(u, s if s is not None else t, r, m) for u, s, r in left for v, t, m in right if u == v] + [("only", None, "y", None), ("other", "T", None, None)]
    out = cycles.merge(spark.createDataFrame(left, "username string, system string, role string"), spark.createDataFrame(right, "username string, system string, manager string"))
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert out.columns == ["username", "system", "role", "manager"]
    assert sorted(map(repr, ((r.username, r.system, r.role, r.manager) for r in rows))) == sorted(map(repr, want))
    assert len({r.task for r in rows if r.username == "h"}) > 1 and max(Counter(r.task for r in rows if r.username == "h").values()) < 50 * 31
