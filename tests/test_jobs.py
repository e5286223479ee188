"""Job fixtures: CSV contract -> cleaned tables and audits."""

import csv
import json

import pytest
from sitelens.operators import profile as PF
from sitelens.plans import jobs as J
from sitelens.sources import csv as CSV


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        for r in rows:
            w.writerow(r)
    return str(path)


def activity_row(**kw):
    return [kw.get(c, "") for c in J.ACTIVITY_SOURCE_COLUMNS]


def test_activities_job(spark, tmp_path):
    shared = dict(PARENTACTIVITYID="W", PARENTACTIVITYNAME="Water")
    rows = [
        activity_row(RECAREAID=" 77", ACTIVITYID="s1", RECAREANAME="Lower Ford", ACTIVITYNAME="Swimming", **shared,
                     RECAREADESCRIPTION="<p>Deep &amp; cold.</p>"),
        activity_row(RECAREAID="77", ACTIVITYID="s2", RECAREANAME="Lower  Ford ", ACTIVITYNAME="Rowing", **shared,
                     RECAREADESCRIPTION="Deep & cold."),
        activity_row(RECAREAID="77", ACTIVITYID="s1", RECAREANAME="Ford", ACTIVITYNAME="Swimming", **shared,
                     RECAREADESCRIPTION="Deep & cold."),
        activity_row(RECAREAID="0078", ACTIVITYID="a9", RECAREANAME="Kite Field", ACTIVITYNAME="Gliding"),
        activity_row(RECAREAID="\t", ACTIVITYID="a9", RECAREANAME="x &amp;  y"),
        activity_row(RECAREAID="0078", RECAREANAME="Kite Field"),
        activity_row(RECAREANAME="<i>none</i>"),
    ]
    res = J.run_activities(spark, write_csv(tmp_path / "raw.csv", J.ACTIVITY_SOURCE_COLUMNS, rows))
    areas = {r.RECAREAID: r for r in res.tables["recreation_areas"].collect()}
    assert set(areas) == {"77", "0078"}
    assert (areas["77"].RECAREANAME, areas["77"].RECAREADESCRIPTION) == ("Lower Ford", "Deep & cold.")
    assert {r.ACTIVITYID for r in res.tables["activities"].collect()} == {"s1", "s2", "a9"}
    pairs = {tuple(r) for r in res.tables["recreation_area_activities"].collect()}
    assert pairs == {("77", "s1"), ("77", "s2"), ("0078", "a9")}
    # the audit holds the rows as they came
    dropped = {r.source_row_number: (r.drop_reason, r.RECAREAID, r.RECAREANAME)
               for r in res.audits["dropped_activity_rows"].collect()}
    assert dropped == {6: ("MISSING_RECAREAID", "\t", "x &amp;  y"), 7: ("MISSING_ACTIVITYID", "0078", "Kite Field"),
                       8: ("MISSING_RECAREAID_AND_ACTIVITYID", "", "<i>none</i>")}
    conflict = res.audits["activity_conflicts"].where("source_column = 'RECAREANAME'").first()
    assert conflict.selected_value == "Lower Ford"
    assert list(json.loads(conflict.value_counts).items()) == [("Lower Ford", 2), ("Ford", 1)]
    assert res.audits["summary"].first().duplicate_relationships_removed == 1
    assert res.audits["issues"].count() == 0


def test_equal_counts_take_the_first_in_text_order(spark, tmp_path):
    rows = [activity_row(RECAREAID="5", ACTIVITYID="p", RECAREANAME=n, ACTIVITYNAME="q") for n in ("Weir", "Mill")]
    res = J.run_activities(spark, write_csv(tmp_path / "t.csv", J.ACTIVITY_SOURCE_COLUMNS, rows))
    assert res.tables["recreation_areas"].first().RECAREANAME == "Mill"


def test_contract_errors(spark, tmp_path):
    src = write_csv(tmp_path / "bad.csv", list(J.ACTIVITY_SOURCE_COLUMNS[:-1]) + ["EXTRA"], [])
    with pytest.raises(CSV.ContractError, match="missing columns: SHAPE; unexpected columns: EXTRA"):
        J.run_activities(spark, src)
    for extra in ("more", ""):
        src = write_csv(tmp_path / f"long{extra}.csv", J.ACTIVITY_SOURCE_COLUMNS, [activity_row(RECAREAID="1") + [extra]])
        with pytest.raises(CSV.ContractError, match="Row 2 .* more fields"):
            J.run_activities(spark, src)


def text(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return str(path)


def test_columns_that_begin_like_sparks_own_names(spark, tmp_path):
    src = text(tmp_path / "c.csv", "_code,,name\n1,x,2\n")
    got = CSV.read_contract_csv(spark, src, exact=["_code", "name"], allow_unnamed=True)
    assert [(r["_code"], r["name"]) for r in got.collect()] == [("1", "2")] and "unnamed_2" not in got.columns
    with pytest.raises(CSV.ContractError, match="_code"):
        CSV.read_contract_csv(spark, src, exact=["name"], allow_unnamed=True)
    with pytest.raises(CSV.ContractError, match="without a name"):
        CSV.read_contract_csv(spark, src, required=["name"])


def test_files_with_other_headers(spark, tmp_path):
    text(tmp_path / "two/1.csv", "x,y\na,b\n")
    text(tmp_path / "two/2.csv", "y,x\nc,d\n")
    with pytest.raises(CSV.ContractError, match="header of"):
        CSV.read_contract_csv(spark, str(tmp_path / "two"), exact=["x", "y"])
    text(tmp_path / "twice.csv", "x,x\n1,2\n")
    with pytest.raises(CSV.ContractError, match="duplicate header"):
        CSV.read_contract_csv(spark, str(tmp_path / "twice.csv"), required=["x"])


def test_rows_are_numbered_by_file(spark, tmp_path):
    for i in range(12):
        text(tmp_path / f"many/{i:02d}.csv", f'\ufeffa,b\n{i},"line one\nline, two"\n{i},\n' if i % 2 else f"a,b\n{i},x\n{i},y\n")
    rows = CSV.read_contract_csv(spark, str(tmp_path / "many"), exact=["a", "b"]).collect()
    assert sorted((int(r.a), r.source_row_number) for r in rows) == [(i, n) for i in range(12) for n in (2, 3)]
    assert {r.b for r in rows if r.a == "1"} == {"line one\nline, two", None}
    assert CSV.row_count(spark, str(tmp_path / "many")) == 24


def test_row_shapes(spark, tmp_path):
    src = text(tmp_path / "s.csv", 'a,b\n1,2\n1\n1,2,\n1,2,3\n"x,""y""",\n')
    got = CSV.read_text_csv(spark, src, ["a", "b"]).orderBy("source_row_number").collect()
    assert [r.row_shape for r in got] == ["exact", "short", "long", "long", "exact"]
    assert got[4].a == 'x,"y"'
    short = text(tmp_path / "short.csv", "a,b\n1\n")
    assert CSV.read_contract_csv(spark, short, exact=["a", "b"]).first().b is None
    with pytest.raises(CSV.ContractError, match="fewer fields"):
        CSV.read_contract_csv(spark, short, exact=["a", "b"], strict=True)


def test_bad_utf8(spark, tmp_path):
    src = text(tmp_path / "b.csv", b"a,b\n1,\xff\xfe\n")
    with pytest.raises(CSV.ContractError, match="UTF-8"):
        CSV.read_contract_csv(spark, src, exact=["a", "b"])


def test_blank_column(spark):
    filled = spark.createDataFrame([("\u00a0",), (None,), ("x",)], "c string")
    CSV.require_blank_column(filled.where("c is null or c <> 'x'"), "c")
    for bad in (filled, filled.limit(0)):
        with pytest.raises(CSV.ContractError):
            CSV.require_blank_column(bad, "c")


def test_publish_is_all_or_nothing(spark, tmp_path):
    from sitelens.sources.tables import StagedPublish
    root = str(tmp_path / "root")
    spark.range(1).write.parquet(f"{root}/b")
    stage = StagedPublish(spark, root)
    for name in ("a", "b"):
        spark.range(5).write.parquet(stage.path(name))
    with pytest.raises(FileExistsError):
        stage.publish()
    stage.discard()
    assert not (tmp_path / "root/a").exists() and spark.read.parquet(f"{root}/b").count() == 1
    stage = StagedPublish(spark, root, overwrite=True)
    for name in ("a", "b"):
        spark.range(5).write.parquet(stage.path(name))
    stage.path("never written")
    with pytest.raises(OSError):
        stage.publish()
    stage.discard()
    assert not (tmp_path / "root/a").exists() and spark.read.parquet(f"{root}/b").count() == 1


def test_phases_stop_at_the_first_failure():
    ran = []
    def phase(name, fail=False):
        def run(results):
            ran.append((name, tuple(results)))
            if fail:
                raise ValueError("no file")
            return len(results)
        return name, run
    assert J.run_phases([phase("one"), phase("two")]) == {"one": 0, "two": 1}
    with pytest.raises(J.PhaseError, match="phase load failed: no file") as e:
        J.run_phases([phase("clean"), phase("load", fail=True), phase("check")])
    assert e.value.phase == "load" and ran[-1] == ("load", ("clean",))


def test_distances_job(spark, tmp_path):
    parks = spark.createDataFrame([("p", 10.0, 20.0), ("q", None, None)], "park_id string, latitude double, longitude double")
    camps = spark.createDataFrame([("c", "10.0", "20.1"), ("d", "", ""), ("e", "1_0.5", "20.0"), ("f", "-10", "20")],
                                  "campground_id string, latitude string, longitude string")
    res = J.run_distances(parks, camps, 100.0)
    assert res.audits["issues"].count() == 0
    s = res.audits["summary"].first()
    assert (s.park_rows, s.park_rows_without_coordinates, s.campground_rows, s.campground_rows_without_coordinates,
            s.distance_rows) == (2, 1, 4, 1, 2)
    J.export_distances(res.tables["distances"], str(tmp_path / "d"))
    lines = [x for f in sorted((tmp_path / "d").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines[0] == "park_id,campground_id,distance_km" and [x[:4] for x in lines[1:]] == ["p,c,", "p,e,"]
    assert [float(x[4:]) for x in lines[1:]] == pytest.approx([10.950578, 55.59754], abs=1e-5)
    assert all(len(x.rpartition(".")[2]) == 6 for x in lines[1:])
    bad = J.check_distances(parks, camps.unionByName(camps.limit(1)), spark.createDataFrame(
        [("p", "c", -1.0), ("p", "c", 101.0), ("p", "e", float("nan"))], "park_id string, campground_id string, distance_km double"), 100.0)
    assert {r.issue for r in bad.collect()} >= {"duplicate_campground_id", "duplicate_distance", "negative_distance",
                                                 "distance_beyond_radius", "distance_not_finite"}


def site_row(**kw):
    base = dict(globalid="{k}", site_cn="0700", site_id="S-07", site_name="Ford Camp", site_subtype="CAMPGROUND",
                fee_charged="Y", total_capacity="12.50", latitude="-41.5", longitude="172.25")
    base.update(kw)
    return [base.get(c, "") for c in J.SITE_REQUIRED_COLUMNS]


def test_campgrounds_job(spark, tmp_path):
    portal = "http://forest.example/p?recid="
    rows = [site_row(globalid="k1", site_subtype="horse  camp", usda_portal_url=portal + "0078"),
            site_row(globalid="k2", site_subtype="PICNIC SITE"),
            site_row(globalid="k3", usda_portal_url=portal + "4"),
            site_row(globalid="k4", usda_portal_url="http://forest.example/none"),
            site_row(globalid="k5", latitude="-90.5"), site_row(globalid=" "), site_row(globalid="k6")]
    src = write_csv(tmp_path / "sites.csv", J.SITE_REQUIRED_COLUMNS, rows)
    areas = spark.createDataFrame([("0078",), ("77",)], "RECAREAID string")
    res = J.run_campgrounds(spark, src, areas)
    camps = {r.campground_id: r for r in res.tables["campgrounds"].collect()}
    assert {k: c.recarea_id for k, c in camps.items()} == {"k1": "0078", "k3": "", "k4": "", "k6": ""}
    assert camps["k1"].fee_charged == "YES" and camps["k1"].total_capacity == "12.5"
    unmatched = {r.campground_id: r.unmatched_reason for r in res.audits["unmatched"].collect()}
    assert unmatched == {"k3": "RECID_NOT_IN_RECREATION_AREAS", "k4": "RECID_NOT_FOUND_IN_USDA_PORTAL_URL",
                         "k6": "MISSING_USDA_PORTAL_URL"}
    dropped = {r.source_row_number: r.drop_category for r in res.audits["dropped"].collect()}
    assert dropped == {3: "UNSUPPORTED_SITE_SUBTYPE", 6: "INVALID_REQUIRED_DATA", 7: "INVALID_REQUIRED_DATA"}
    assert res.audits["issues"].count() == 0
    s = res.audits["summary"].first()
    assert (s.source_row_count, s.final_campground_row_count, s.dropped_row_count) == (7, 4, 3)


def test_parks_job_and_publish(spark, tmp_path):
    header = [""] + list(J.PARK_SOURCE_COLUMNS)
    rows = [["7", "Peat Moor *", "", "Norrland65°30′N 20°15′E / 65.5°N 20.25°E", "July 4, 1988[9]",
             "1,250.75 acres (5 km2)", "98,765", "Bogs [31]."],
            ["8", "Vague", "\u00a0", "up north", "in spring", "large", "1.5", "y"], ["9", " ", "", "", "", "", "", ""]]
    res = J.run_parks(spark, write_csv(tmp_path / "parks.csv", header, rows))
    parks = {r.name: r for r in res.tables["parks"].collect()}
    assert set(parks) == {"Peat Moor", "Vague"}
    a = parks["Peat Moor"]
    assert (a.state_or_territory, a.latitude, a.longitude, a.area_acres, a.recreation_visitors_2021) == (
        "Norrland", 65.5, 20.25, 1250.75, 98765)
    reasons = sorted(r.failure_reason for r in res.audits["failures"].collect())
    assert reasons == ["MISSING_PARK_NAME", "UNPARSEABLE_ACREAGE", "UNPARSEABLE_DATE",
                       "UNPARSEABLE_OR_OUT_OF_RANGE_COORDINATES", "UNPARSEABLE_VISITOR_COUNT"]
    out = str(tmp_path / "out")
    J.publish(spark, res, out)
    assert spark.read.parquet(out + "/parks").count() == 2
    with pytest.raises(FileExistsError):
        J.publish(spark, res, out)


def test_profile_job(spark, tmp_path):
    src = write_csv(tmp_path / "p.csv", ["plot_id", "trees", "", "state"],
                    [["07", "3", "1", "\u00a0"], ["08", "4", "1", "wet"], ["08", "4", "1", "dry"], ["07", "3", "1", "\u00a0"]])
    out = J.profile_source(spark, src, "p", extra_keys=[("plot_id", "trees")])
    prof = {r.column_position: r for r in out["column_profile"].collect()}
    assert [prof[i].inferred_data_type for i in (1, 2, 4)] == ["string", "integer", "string"]
    assert prof[3].inferred_data_type == "string"
    n = prof[4]
    assert (n.missing_count, n.distinct_count, n.maximum_text_length, n.sample_values) == (2, 2, 3, "wet|dry")
    dup = out["duplicate_rows"].first()
    assert (dup.exact_duplicate_group_count, dup.exact_duplicate_row_count) == (1, 1)
    keys = {r.candidate: r for r in out["key_analysis"].collect()}
    assert keys["plot_id,trees"].duplicate_non_missing_rows == 2 and not keys["plot_id"].is_candidate_key


@pytest.mark.parametrize("name,expected", [("plot_id", True), ("GlobalID", True), ("site_cn", True), ("CN ", True), (" ", True),
                                            ("", True), ("cnt", False), ("acn", False), ("identity", False), ("paid", True)])
def test_identifier_names(name, expected):
    assert PF.is_identifier_name(name) == expected


def test_pipeline_publishes_every_phase(spark, tmp_path):
    header = list(J.PARK_SOURCE_COLUMNS)
    parks = write_csv(tmp_path / "parks.csv", header, [
        ["Alpha", "", "Maine 44°21′N 68°13′W / 44.35°N 68.21°W", "February 26, 1919", "49,071.40 acres", "4,069,098", "d"],
        ["", "", "x", "y", "z", "1", "d"]])
    acts = write_csv(tmp_path / "acts.csv", J.ACTIVITY_SOURCE_COLUMNS, [
        activity_row(RECAREAID="1", RECAREANAME="Area", ACTIVITYID="9", ACTIVITYNAME="Biking")])
    sites = write_csv(tmp_path / "sites.csv", J.SITE_REQUIRED_COLUMNS, [site_row(latitude="44.4", longitude="-68.3")])
    root = str(tmp_path / "out")
    got = J.run_pipeline(spark, {"parks": parks, "activities": acts, "sites": sites}, root, 50.0)
    assert list(got) == ["parks", "activities", "campgrounds", "distances"]
    assert got["distances"]["distances"].count() == 1
    summary = {(r.metric, r.category): r.value for r in spark.read.json(f"{root}/parks/figures").collect()}
    assert summary["source_row_count", ""] == 2 and summary["processed_park_row_count", ""] == 1
    assert summary["parse_failure_counts_by_reason", "MISSING_PARK_NAME"] == 1
    figures = {(r.metric, r.category): r.value for r in spark.read.json(f"{root}/campgrounds/figures").collect()}
    assert figures["final_campground_row_count", ""] == 1 and figures["retained_subtype_counts", "HORSE CAMP"] == 0
    with pytest.raises(J.PhaseError, match="phase parks"):
        J.run_pipeline(spark, {"parks": parks, "activities": acts, "sites": sites}, root, 50.0)


def test_accounting_issue(spark):
    n = lambda k: spark.range(k)
    assert J.accounting_issue(n(5), n(3), n(2), "rows").collect() == []
    assert [tuple(r) for r in J.accounting_issue(n(5), n(3), n(1), "rows").collect()] == [("unaccounted_rows", "5:3:1")]
