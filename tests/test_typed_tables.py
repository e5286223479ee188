"""Typed load of the six tables: order, one commit, checks, views, source counts."""

import pytest

from sitelens.operators import quality as Q
from sitelens.plans import typed_tables as TT
from sitelens.plans.jobs import JobCheckError
from sitelens.sources.csv import ContractError
from sitelens.sources.tables import ColumnSpec, ForeignKey, TableSpec, load_order
from sitelens.sources.versions import VersionConflict, VersionStore

GOOD = {
    "national_parks": [dict(park_id="p1", name="Alpha", state_or_territory="MT", latitude="10.5", longitude="-20",
                            established_date="1999-01-02", area_acres="12.25", recreation_visitors_2021="7", description="d")],
    "recreation_areas": [dict(RECAREAID="007", X="", Y="12.5", RECAREANAME="Area", LONGITUDE="1", LATITUDE="2", RECAREAURL="u",
                              OPEN_SEASON_START="May", OPEN_SEASON_END="", FORESTNAME="F", MARKERTYPE="", MARKERACTIVITY="",
                              MARKERACTIVITYGROUP="", RECAREADESCRIPTION="two\nlines", SPOTLIGHTDISPLAY="Y",
                              ATTRACTIONDISPLAY="N", ACCESSIBILITY="", OPENSTATUS="open", SHAPE="")],
    "activities": [dict(ACTIVITYID="9", ACTIVITYNAME="Biking", PARENTACTIVITYID="1", PARENTACTIVITYNAME="")],
    "campgrounds": [dict({f: "x" for f in TT.CAMPGROUND_FIELDS}, campground_id=i, globalid=i, site_subtype="CAMPGROUND",
                         fee_charged="NO", water_availability="UNKNOWN", restroom_availability="NONE", total_capacity="42.5",
                         latitude="1", longitude="2", recarea_id=link) for i, link in (("c1", "007"), ("c2", ""))],
    "recreation_area_activities": [dict(RECAREAID="007", ACTIVITYID="9")],
    "park_campground_distances": [dict(park_id="p1", campground_id="c1", distance_km="3.500000")],
}


def frames(spark, **changed):
    out = {}
    for spec in TT.SPECS:
        rows = [dict(r) for r in changed.get(spec.name, GOOD[spec.name])]
        data = [(n, *[r[c] for c in spec.source_columns]) for n, r in enumerate(rows, 2)]
        schema = "source_row_number long, " + ", ".join(f"`{c}` string" for c in spec.source_columns)
        out[spec.name] = spark.createDataFrame(data, schema)
    return out


def test_load_order():
    names = [s.name for s in load_order(tuple(reversed(TT.SPECS)))]
    for s in TT.SPECS:
        assert all(names.index(r.table) < names.index(s.name) for r in s.references)
    one = lambda name, *to: TableSpec(name, [ColumnSpec("k", "k")], ("k",), tuple(ForeignKey("k", t) for t in to))
    assert [s.name for s in load_order([one("c", "b"), one("b", "a"), one("a", "a")])] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="circle"):
        load_order([one("a", "b"), one("b", "a")])
    with pytest.raises(ValueError, match="without a spec"):
        load_order([one("a", "gone")])


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"))
    assert store.manifest().number == 0 and store.tables() == {}
    first = store.begin()
    first.write("a", spark.range(3))
    assert store.tables() == {}  # written, not committed
    first.commit()
    late, other = store.begin(), store.begin()
    late.write("a", spark.range(5))
    other.write("a", spark.range(7))
    reader = store.tables()["a"]
    other.commit()
    with pytest.raises(VersionConflict):
        late.commit()
    late.discard()
    assert (reader.count(), store.table("a").count(), store.tables(1)["a"].count()) == (3, 7, 3)
    assert store.drop_all().number == 3 and store.tables() == {}
    store.vacuum(keep=2)
    assert store.tables(2)["a"].count() == 7
    with pytest.raises(Exception):
        store.tables(1)["a"].count()


def test_load_and_views(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"))
    TT.export_tables({k: v.drop("source_row_number") for k, v in frames(spark).items()}, str(tmp_path / "text"))
    raw = TT.read_exported(spark, str(tmp_path / "text"))
    loaded = TT.load_tables(spark, raw, store)
    assert {(r.table_name, r.source_rows, r.table_rows) for r in loaded.counts.collect()} == {
        (n, len(rows), len(rows)) for n, rows in GOOD.items()}
    area = store.table("recreation_areas").first()
    assert (area.recarea_id, area.longitude, area.latitude, area.open_season_end, area.spotlight_display,
            area.attraction_display, area.description) == ("007", None, 12.5, None, 1, 0, "two\nlines")
    assert dict(store.table("national_parks").dtypes)["recreation_visitors_2021"] == "bigint"
    TT.open_views(store)
    assert [r.campground_id for r in spark.sql("select * from campground_activity_details").collect()] == ["c1"]
    assert spark.sql("select sum(has_recreation_area_link) s from campground_data_completeness").first().s == 1
    assert all(r.equal for r in TT.source_counts(spark, str(tmp_path / "text"), store).collect())
    with pytest.raises(FileExistsError):
        TT.load_tables(spark, raw, store)
    assert TT.load_tables(spark, raw, store, overwrite=True).manifest.number == 2


@pytest.mark.parametrize("table,change,said", [
    ("campgrounds", dict(recarea_id="404"), r"campgrounds.recarea_id_not_in_recreation_areas \(404\)"),
    ("campgrounds", dict(water_availability="WET"), r"campgrounds.invalid_water_category"),
    ("campgrounds", dict(globalid="other"), r"campground_id_is_not_globalid"),
    ("park_campground_distances", dict(distance_km="-1"), r"negative_distance_km \(p1:c1\)"),
    ("national_parks", dict(latitude="90.5"), r"latitude_out_of_range \(p1\)"),
    ("national_parks", dict(area_acres="many"), r"area_acres does not take many \(source row 2\)"),
    ("national_parks", dict(description=""), r"description does not take  \(source row 2\)"),
    ("recreation_areas", dict(SPOTLIGHTDISPLAY="maybe"), r"spotlight_display does not take maybe"),
    ("recreation_area_activities", dict(ACTIVITYID="8"), r"activity_id_not_in_activities \(8\)"),
])
def test_an_issue_leaves_nothing_behind(spark, tmp_path, table, change, said):
    store = VersionStore(spark, str(tmp_path / "s"))
    rows = [dict(GOOD[table][0], **change), *GOOD[table][1:]]
    with pytest.raises(JobCheckError, match=said):
        TT.load_tables(spark, frames(spark, **{table: rows}), store)
    assert store.tables() == {} and not list((tmp_path / "s").glob("data-*"))


def test_many_issues_are_counted(spark, tmp_path):
    rows = GOOD["activities"] * 1 + [dict(GOOD["activities"][0], ACTIVITYID=f"a{i:02d}") for i in range(1, 14) for _ in (0, 1)]
    with pytest.raises(JobCheckError, match=r"activities.duplicate_key \(a10\) and 3 more"):
        TT.load_tables(spark, frames(spark, activities=rows), VersionStore(spark, str(tmp_path / "s")))


def test_header_in_another_order(spark, tmp_path):
    TT.export_tables({k: v.drop("source_row_number") for k, v in frames(spark).items()}, str(tmp_path / "text"))
    raw = frames(spark)["activities"].select("ACTIVITYNAME", "ACTIVITYID", "PARENTACTIVITYID", "PARENTACTIVITYNAME")
    raw.write.mode("overwrite").option("header", True).csv(str(tmp_path / "text/activities"))
    with pytest.raises(ContractError, match="another order"):
        TT.read_exported(spark, str(tmp_path / "text"))


def _stored(spark, path, groups):
    """Rows (a, b) in one file a group, in the given order."""
    for rows in groups:
        spark.createDataFrame(rows, "a string, b string").coalesce(1).write.mode("append").parquet(str(path))
    return spark.read.schema("a string, b string").parquet(str(path))


ORDERED = [[("a", f"{i:03d}") for i in range(50)], [("a", "1"), ("b", "0"), ("é", "0")], [("ö", "0"), ("ö", "00")]]


def test_sorted_pairs_are_not_shuffled(spark, tmp_path):
    df = _stored(spark, tmp_path / "t", ORDERED)
    assert Q.keys_ascend(df, ["a", "b"]) and Q.keys_ascend(df.limit(0), ["a", "b"])
    found = Q.stored_duplicate_issues(df, ["a", "b"], "twice")
    assert found.collect() == [] and found.schema == Q.duplicate_issues(df, ["a", "b"], "twice").schema
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("more,want", [
    ([("ö", "00"), ("z", "1")], ["ö:00"]),            # the end of one file and the start of another
    ([("a", "010")], ["a:010"]),                      # inside another file's run
    ([("x", "1"), ("x", "1")], ["x:1"]),              # neighbours
    ([("x", "1"), ("c", "1"), ("x", "1")], ["x:1"]),  # out of order
    ([(None, "1"), (None, "1"), (None, "2")], [None]),
    ([(f"{i * 7 % 600:03d}", "9") for i in range(601)], ["000:9"]),
    ([(f"{i * 7 % 600:03d}", "9") for i in range(600)], [])])
def test_repeated_stored_keys(spark, tmp_path, more, want):
    df = _stored(spark, tmp_path / "t", [*ORDERED, more])
    assert sorted(r.record_key for r in Q.stored_duplicate_issues(df, ["a", "b"], "twice").collect()) == want
    assert not want or not Q.keys_ascend(df, ["a", "b"])


def test_runs_are_the_same_however_rows_are_batched(spark, tmp_path):
    df = _stored(spark, tmp_path / "t", ORDERED)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert Q.keys_ascend(df, ["a", "b"])
        assert not Q.keys_ascend(df.unionByName(df.limit(1)), ["a", "b"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_repeated_pair_in_the_text_is_an_issue(spark, tmp_path):
    rows = GOOD["park_campground_distances"] * 2
    with pytest.raises(JobCheckError, match=r"park_campground_distances.duplicate_key \(p1:c1\)"):
        TT.load_tables(spark, frames(spark, park_campground_distances=rows), VersionStore(spark, str(tmp_path / "s")))
