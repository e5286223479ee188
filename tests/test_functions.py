"""Scalar rules on small vectors."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from column_helpers import apply, one_col
from sitelens.functions import amenities as A
from sitelens.functions import geo as G
from sitelens.functions import parse as PR
from sitelens.functions import text as TX


def test_haversine_vectors(spark):
    quarter = 6371.0088 * 3.141592653589793 / 2
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 90.0), (-33.0, 151.0, -33.0, 151.0), (0.0, 179.5, 0.0, -179.5), (90.0, 12.0, 0.0, -77.0)],
        "a double, b double, c double, d double")
    got = [r[0] for r in df.select(G.haversine_km("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([quarter, 0.0, quarter / 90, quarter], abs=1e-6)
    atan = [r[0] for r in df.select(G.haversine_atan2_km("a", "b", "c", "d")).collect()]
    assert atan == pytest.approx(got, abs=1e-9)


WATER = [("Spigot with well water at the entrance", "AVAILABLE"), ("not provided", "NOT_AVAILABLE"),
         ("Filter what you draw from the tank", "NATURAL_SOURCE"), ("The lake is close", "NATURAL_SOURCE"),
         ("Tap at the work center", "NEARBY"), ("System currently offline", "NOT_AVAILABLE"),
         ("YES...", "AVAILABLE"), ("For stock only", "OTHER"), ("portable water", "OTHER"),
         ("Call ahead", "UNKNOWN"), ("  ", "UNKNOWN"), (None, "UNKNOWN"), ("Not Specified", "UNKNOWN"),
         ("Available early in May", "AVAILABLE"), ("no streams, no taps", "NATURAL_SOURCE")]


def test_water(spark):
    assert apply(spark, A.normalize_water, [w for w, _ in WATER]) == [c for _, c in WATER]


RESTROOM = [("two flushing units", "FLUSH"), ("pit", "VAULT"), ("compost loo", "COMPOSTING"),
            ("porta pot by the road", "PORTABLE"), ("vault and portable units", "MULTIPLE"),
            ("toilets are not available", "NONE"), ("Facility at the trailhead", "OTHER"),
            ("available with a reservation", "UNKNOWN"), ("Unknown toilet type", "UNKNOWN"), (None, "UNKNOWN"), ("", "UNKNOWN")]


def test_restroom(spark):
    assert apply(spark, A.normalize_restroom, [w for w, _ in RESTROOM]) == [c for _, c in RESTROOM]


def test_fee_capacity_subtype(spark):
    assert apply(spark, A.convert_fee, [" y", "N", "yes", None]) == ["YES", "NO", "UNKNOWN", "UNKNOWN"]
    assert apply(spark, A.parse_total_capacity, ["7", "130.250", " 18 ", "018", "-4", "dozens"]) == \
        ["7", "130.25", "18", "", "", ""]
    assert apply(spark, TX.normalize_site_subtype, ["horse\u00a0 camp\n"]) == ["HORSE CAMP"]


def test_display_name(spark):
    df = spark.createDataFrame([("One", "Two", "Three"), ("  ", "Two", "Three"), (None, "", "Three\t"), (None, None, None)],
                               "a string, b string, c string")
    got = [r[0] for r in df.select(TX.first_non_blank("a", "b", "c")).collect()]
    assert got == ["One", "Two", "Three", ""]


def test_recid(spark):
    urls = ["http://forest.example/page?recid=0900", "forest.example/p?id=1&ReCiD=17&recid=18",
            "http://forest.example/recid=5", None, "http://forest.example/?recid=%2040%20"]
    assert apply(spark, PR.extract_query_param, urls) == ["0900", "17", "", "", "40"]


def test_python_whitespace_class(spark):
    assert apply(spark, TX.clean_text, ["\x1dleft\u2003right\x85", None]) == ["left right", ""]


def test_coordinates_text(spark):
    vals = ["3.25°S 60.5°W", "71.0°N 25.75°E", "36°30′N 5°45′W", "somewhere north", "12.0°N 181.0°E"]
    got = apply(spark, lambda c: PR.parse_coordinates(c), vals)
    assert [(g.latitude, g.longitude) for g in got[:3]] == [(-3.25, -60.5), (71.0, 25.75), (36.5, -5.75)]
    assert got[3].latitude is None and got[4].latitude is None


def test_location_with_css_noise(spark):
    text = "Norrland.mw-parser-output .x{display:none}65°30′N 20°15′E / 65.5°N 20.25°E"
    df = spark.createDataFrame([(text,)], "location string")
    staged = PR.with_location(df, "location", "_loc").select("_loc").first()[0]
    col = df.select(PR.parse_location("location").alias("l")).first()[0]
    for r in (staged, col):
        assert (r.label, r.latitude, r.longitude) == ("Norrland", 65.5, 20.25)


def test_date_area_visitors(spark):
    assert apply(spark, PR.parse_long_date, ["July 4, 1988[9]", "in spring"]) == [dt.date(1988, 7, 4), None]
    assert apply(spark, PR.parse_acreage_text, ["1,250.75 acres (5 km2)", "large"]) == ["1250.75", None]
    assert apply(spark, PR.parse_visitors, ["98,765", "1.5"]) == [98765, None]


def test_names_citations_ids(spark):
    assert apply(spark, TX.clean_park_name, [" North–South Range * "]) == ["North–South Range"]
    assert apply(spark, TX.remove_citation_markers, ["Old growth[2] and bogs [31]."]) == ["Old growth and bogs ."]
    ids = apply(spark, PR.make_entity_id, ["Green  Hills ", "GREEN HILLS", " "])
    assert ids[0] == ids[1] and ids[2] == ""
    assert ids[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, PR.DEFAULT_ID_PREFIX + "green hills"))


def test_html_text(spark):
    got = apply(spark, TX.html_to_text,
                ["<div>One&nbsp;two</div><div>three &lt; four</div>", "<style>a{}</style>Seen<script>b()</script>",
                 "if 5<10 then", "<p>a<b>b</b>c</p><template>hidden</template>", "a<!-- x -->b", None])
    assert got == ["One two three < four", "Seen", "if 5<10 then", "a b c", "a b", None]


def test_load_converters(spark):
    assert apply(spark, PR.null_if_missing, ["", "NaN", "Nan", "UNKNOWN"]) == [None, "NaN", "Nan", "UNKNOWN"]
    assert apply(spark, PR.as_integer, ["31", "3.5", "", "4d"]) == [31, None, None, None]
    assert apply(spark, PR.as_real, ["3.5", "1e2", "1d", "inf", "nan", "", "0x1"]) == [3.5, 100.0, None, None, None, None, None]
    assert apply(spark, PR.as_yn_flag, ["N", "Y", "y"]) == [0, 1, None]


def test_unusual_whitespace(spark):
    got = apply(spark, TX.has_unusual_whitespace,
                ["plain name", "tail ", "a\tb", "a\t\tb", "a\u2009b", "a\u200bb", "\nname", ""])
    assert got == [False, True, False, True, True, True, True, False]


def test_blank(spark):
    assert apply(spark, TX.is_blank, [None, "", " \t\n", "\u00a0\u3000", "x ", "\x1f"]) == [True, True, True, True, False, True]


def test_coordinate_text(spark):
    values = [44.35, -68.21, 0.1 + 0.2, 100.0, -0.0, 1e-5, 123.456789012345678, None, 1.0e-4]
    assert apply(spark, G.coordinate_text, values, "double") == [None if v is None else format(v, ".15g") for v in values]


def test_numbers_that_need_no_cleaning_are_read_as_they_stand(spark):
    values = ["1", "-1.5", "+.5", "1.", "1e3", "1E-2", "1_0", " 7 ", " 7", "7\n", "7 ", "7\u0085", "1 0", "", None, "nan", "inf", "1d",
              "0x1", "1e999", "--1", "1__0", "_1", "١"]
    want = [1.0, -1.5, 0.5, 1.0, 1000.0, 0.01, 10.0, 7.0, 7.0, 7.0, 7.0, 7.0, None, None, None, None, None, None, None, float("inf"),
            None, None, None, None]
    assert apply(spark, PR.parse_number, values) == want
    # before, every number went through replacements of text first
    plan = one_col(spark, ["1"]).select(PR.parse_number("v"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "cast(" in plan and plan.index("cast(") < plan.index("regexp_replace")
