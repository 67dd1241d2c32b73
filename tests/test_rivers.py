"""A river service with nulls, empty collections, many-to-many, recursion and scopes."""

import json
from dataclasses import replace
from datetime import datetime

import pytest

from odata_spark.edm import EntitySpec, Nav, Registry, ServiceOptions
from odata_spark.service import Service
from odata_spark.sources import SnapshotStore

DAY = datetime(2021, 6, 1)
TABLES = {
    "Basin": ("id string, title string, parentId string, area double", [("rh", "Rhine", None, 185.0), ("ne", "Neckar", "rh", 14.0), ("en", "Enz", "ne", 2.2), ("do", "Danube", None, 801.0)]),
    "Station": ("id int, label string, basinId string, height double, changed timestamp_ntz, note string", [(11, "Upper weir", "ne", 212.5, DAY, "n"), (12, "Old bridge", "rh", 98.0, None, "n"), (13, "Mill race", "en", None, DAY, "n"), (14, "Harbour 'A'", None, 3.5, DAY, "n"), (15, "Lower weir", "ne", 170.25, DAY, "n")]),
    "Sensor": ("id int, kind string", [(1, "radar"), (2, "float"), (3, "camera")]),
    "StationSensor": ("stationId int, sensorId int", [(11, 1), (11, 3), (12, 2), (15, 1), (15, 2)]),
    "Reading": ("id int, stationId int, level double, valid boolean", [(1, 11, 2.5, True), (2, 11, 3.75, True), (3, 12, 6.0, False), (4, 15, 0.5, True), (5, 15, None, True), (6, 13, 1.0, False)]),
}
NAVS = {
    "Basin": (Nav("parent", "Basin", (("parentId", "id"),)), Nav("children", "Basin", (("id", "parentId"),), True), Nav("stations", "Station", (("id", "basinId"),), True)),
    "Station": (Nav("basin", "Basin", (("basinId", "id"),)), Nav("readings", "Reading", (("id", "stationId"),), True)),
    "Sensor": (),
    "Reading": (Nav("station", "Station", (("stationId", "id"),)),),
}
MORE = {
    "Basin": dict(searchable=("title",), max_expand_depth=3),
    "Station": dict(searchable=("label",), exclude=frozenset({"note"}), etag="changed", computed=frozenset({"changed"}), scope=lambda df, ctx: df.where(df["basinId"] == ctx.request) if ctx.request else df),
}


def build(spark, store=None, options=ServiceOptions()):
    def frame(name):
        schema, rows = TABLES[name]
        return spark.createDataFrame(rows, schema)

    specs = []
    for name, navs in NAVS.items():
        if name == "Station":
            navs += (Nav("sensors", "Sensor", (("id", "stationId"),), True, lambda s: frame("StationSensor"), (("sensorId", "id"),)),)
        if store:
            store.create(f"{name}s", frame(name).drop("note"))
        source = store.source(f"{name}s") if store else lambda s, name=name: frame(name)
        specs.append(EntitySpec(name, ("id",), source, navs=navs, **MORE.get(name, {})))
    return Service(Registry(spark, specs, options), store)


@pytest.fixture(scope="module")
def rivers(spark):
    return build(spark)


def get(service, url, request=None):
    r = service.handle("GET", "/odata/" + url, request=request)
    assert r.status == 200, r.body
    return r.body


def ids(service, url, request=None):
    return sorted(x["id"] for x in get(service, url, request)["value"])


FILTERS = {
    "basin/title eq 'Neckar' and height lt 200": [15],
    "endswith(basin/title,'e') or height eq null": [12, 13],
    "basin/parent/title eq 'Rhine'": [11, 15],
    "not (basin/area gt 10)": [13],
    "readings/any(r:r/level ge 3)": [11, 12],
    "readings/all(r:r/valid eq true)": [11, 14, 15],
    "readings/ANY(r:r/level mul 20 gt $it/height)": [12],
    "sensors/any(s:s/kind eq 'float' or s/kind eq 'camera')": [11, 12, 15],
    "sensors/any() and not sensors/any(s:s/kind eq 'radar')": [12],
    "readings/any(r:r/station/label eq 'Mill race')": [13],
    "basinId eq null": [14],
    "basin/title ne null": [11, 12, 13, 15],
    "label eq 'Harbour ''A'''": [14],
    "height div 0 eq null": [11, 12, 13, 14, 15],
    "id div 4 eq 3 and id mod 4 ge 2": [14, 15],
    "id div 0 eq null and id lt 12": [11],
    "tolower(label) eq 'mill race'": [13],
}


@pytest.mark.parametrize("condition", FILTERS)
def test_filters(rivers, condition):
    assert ids(rivers, f"Stations?$filter={condition}") == FILTERS[condition]


def test_search(rivers):
    assert ids(rivers, "Stations?$search=weir AND NOT lower") == [11]
    assert ids(rivers, 'Stations?$search="old bridge" OR mill') == [12, 13]


def test_whole_division_is_exact(spark):
    from pyspark.sql import functions as F

    from odata_spark.functions import arithmetic

    df = spark.createDataFrame([(9007199254740993, 1), (-7, 2), (5, 0)], "a long, b long")
    assert [r[0] for r in df.select(arithmetic("div", F.col("a"), F.col("b"), True)).collect()] == [9007199254740993, -3, None]


ERRORS = {
    400: ["Stations?$filter=readings/level gt 1", "Stations?$expand=readings($search=x)", "Stations?$expand=readings($bogus=1)", "Stations?$filter=depth eq 1", "Stations?$filter=note eq 'n'", "Stations?$select=note", "Stations?$top=5000", "Stations?$filter=height", "Basins?$expand=parent($levels=9)", "Stations?$filter=label eq 7", "Stations?$expand=basin($count=true)", "Stations?$apply=aggregate(depth with max as d)", "Stations?$filter=" + " or ".join(["id lt 3"] * 15)],
    404: ["Rivers", "Stations(404)", "Basins('zz')"],
    501: ["Stations?$orderby=basin/title", "Stations?$expand=readings/$ref", "Stations?$expand=readings($compute=level)", "Stations?$filter=label has 2", "Stations?$skiptoken=abc", "Stations?$expand=readings($filter=$it/id eq 11)"],
}


@pytest.mark.parametrize("status", ERRORS)
def test_errors(rivers, status):
    for url in ERRORS[status]:
        r = rivers.handle("GET", "/odata/" + url)
        assert r.status == status and r.body["error"]["code"], url


def test_expand(rivers):
    rows = get(rivers, "Stations?$expand=readings($count=true;$top=1;$orderby=id desc)&$orderby=id")["value"]
    assert [r["readings@odata.count"] for r in rows] == [2, 1, 1, 0, 2] and [[x["id"] for x in r["readings"]] for r in rows] == [[2], [3], [6], [], [5]]
    rows = get(rivers, "Stations?$expand=sensors($filter=kind ne 'radar';$orderby=kind),basin($select=title)&$filter=id ne 13&$orderby=id")["value"]
    assert [[s["kind"] for s in r["sensors"]] for r in rows] == [["camera"], ["float"], [], ["float"]]
    assert rows[0]["basin"] == {"title": "Neckar", "id": "ne"} and rows[2]["basin"] is None
    rows = get(rivers, "Stations?$expand=sensors($orderby=kind desc;$skip=1;$top=1)&$filter=basinId eq 'ne'&$orderby=id")["value"]
    assert [[s["kind"] for s in r["sensors"]] for r in rows] == [["camera"], ["float"]]
    assert [r["children@odata.count"] for r in get(rivers, "Basins?$expand=children/$count&$orderby=id")["value"]] == [0, 0, 1, 1]
    rows = get(rivers, "Basins?$expand=stations/$count($filter=height gt 200)&$orderby=title")["value"]
    assert [(r["title"], r["stations@odata.count"]) for r in rows] == [("Danube", 0), ("Enz", 0), ("Neckar", 1), ("Rhine", 0)] and "stations" not in rows[0]
    up = get(rivers, "Basins('en')?$expand=parent($levels=2)")
    assert (up["parent"]["id"], up["parent"]["parent"]["id"]) == ("ne", "rh")
    assert get(rivers, "Basins('en')?$expand=parent($levels=max)")["parent"]["parent"]["parent"] is None
    down = get(rivers, "Basins('rh')?$expand=children($search=neck;$expand=stations($select=label;$orderby=label))")
    assert [s["label"] for s in down["children"][0]["stations"]] == ["Lower weir", "Upper weir"]


def test_scopes(rivers):
    assert ids(rivers, "Stations", "ne") == [11, 15] and ids(rivers, "Stations?$filter=height lt 200", "ne") == [15]
    assert ids(rivers, "Readings?$filter=station/label eq 'Old bridge'") == [3] and ids(rivers, "Readings?$filter=station/label eq 'Old bridge'", "ne") == []
    assert get(rivers, "Basins('ne')?$expand=stations/$count", "rh")["stations@odata.count"] == 0
    assert rivers.handle("GET", "/odata/Stations(12)", request="ne").status == 404
    with pytest.raises(ValueError):
        Registry(rivers.registry.spark, [rivers.registry.types["Sensor"]], ServiceOptions(require_scope=True))


def test_envelope(spark):
    rivers = build(spark, options=ServiceOptions(max_top=3))
    r = get(rivers, "Stations?$count=true&$orderby=label desc")
    assert r["@odata.count"] == 5 and r["@odata.context"].endswith("#Stations") and [x["id"] for x in r["value"]] == [11, 12, 13]
    assert r["value"][0]["@odata.id"] == "/odata/Stations(11)" and r["value"][0]["basin@odata.navigationLink"] and "$skip=3" in r["@odata.nextLink"]
    rest = rivers.handle("GET", r["@odata.nextLink"]).body
    assert [x["id"] for x in rest["value"]] == [15, 14] and "@odata.nextLink" not in rest
    assert rivers.handle("GET", "/odata/Readings/$count?$filter=valid eq false").text() == "2"
    assert get(rivers, "Basins/do")["@odata.context"].endswith("#Basins/$entity") and get(rivers, "Basins?$select=area")["@odata.context"].endswith("#Basins(area)")
    assert get(rivers, "Readings?$apply=groupby((stationId),aggregate(level with max as top))&$top=2")["@odata.context"].endswith("#Readings(stationId,top)")
    assert {"name": "Sensors", "url": "Sensors", "kind": "EntitySet"} in get(rivers, "")["value"]
    xml = rivers.handle("GET", "/odata/$metadata").text()
    assert '<NavigationProperty Name="sensors" Type="Collection(Default.Sensor)"/>' in xml and '"note"' not in xml and "Core.V1.Computed" in xml
    assert rivers.handle("PUT", "/odata/Stations").status == 405


def test_writes(spark, tmp_path):
    rivers = build(spark, SnapshotStore(spark, str(tmp_path)))
    send = lambda verb, url, body=None, **headers: rivers.handle(verb, "/odata/" + url, {k.replace("_", "-"): v for k, v in headers.items()}, body)
    made = send("POST", "Stations", {"id": 40, "label": "Ferry", "height": 7})
    assert made.status == 201 and made.headers["Location"] == "/odata/Stations(40)" and made.body["changed"]
    assert send("POST", "Stations", {"id": 40, "label": "Again"}).status == 409 and send("POST", "Stations", {"id": 41, "depth": 1}).status == 400
    tag = send("GET", "Stations(40)").headers["ETag"]
    assert send("GET", "Stations(40)", If_None_Match=tag).status == 304 and send("PATCH", "Stations(40)", {"height": 8}, If_Match='W/"b2xk"').status == 412
    assert send("PATCH", "Stations(40)", {"height": 8}, If_Match=tag, Prefer="return=minimal").status == 204
    whole = send("PUT", "Stations(40)", json.dumps({"label": "Ferry landing"})).body
    assert whole["height"] is None and whole["label"] == "Ferry landing"
    assert [send("DELETE", "Stations(40)").status for _ in range(2)] == [204, 404]
    deep = send("POST", "Basins", {"id": "we", "title": "Weser", "stations": [{"id": 50, "label": "Lock"}, {"id": 51}]})
    assert deep.status == 201 and send("GET", "Stations/$count?$filter=basinId eq 'we'").text() == "2"
    bad = send("POST", "Basins", {"id": "el", "stations": [{"id": 60}, {"id": "sixty"}]})
    assert bad.status == 400 and bad.body["error"]["target"] == "stations[1]" and send("GET", "Basins('el')").status == 404


def test_batch(spark, tmp_path):
    rivers = build(spark, SnapshotStore(spark, str(tmp_path)))

    def part(number, request, body=""):
        return ["Content-Type: application/http", f"Content-ID: {number}", "", f"{request} HTTP/1.1", "Content-Type: application/json", "", body]

    def batch(change):
        changes = ["--inner", *part("new", "POST Sensors", '{"id": 9, "kind": "laser"}'), "--inner", *part("more", change, '{"kind": "lidar"}'), "--inner--"]
        lines = ["--outer", 'Content-Type: multipart/mixed; boundary="inner"', "", *changes, "--outer", *part("n", "GET Sensors/$count"), "--outer--", ""]
        return rivers.handle("POST", "/odata/$batch", {"Content-Type": "multipart/mixed; boundary=outer"}, "\r\n".join(lines)).text()

    assert "HTTP/1.1 404" in batch("PATCH Sensors(77)") and rivers.handle("GET", "/odata/Sensors/$count").text() == "3"
    out = batch("PATCH $new")
    assert "HTTP/1.1 201" in out and out.count("HTTP/1.1 200") == 2 and get(rivers, "Sensors(9)")["kind"] == "lidar"
    for kind in ("text/plain", "multipart/mixed", "multipart/form-data; boundary=outer"):
        assert rivers.handle("POST", "/odata/$batch", {"Content-Type": kind}, "--outer--").status == 400


def test_handlers_and_views(spark):
    base = build(spark).registry.types["Sensor"]
    numbered = replace(base, handlers={"create": lambda body, request: body | {"id": len(body["kind"])}}, name="Probe", set_name="Probes")
    kinds = replace(base, name="SensorKind", set_name="SensorKinds", view=("kind",), read_only=True)
    s = Service(Registry(spark, [numbered, kinds]))
    assert s.handle("POST", "/odata/Probes", body={"kind": "sonar"}).headers["Location"] == "/odata/Probes(5)"
    refused = s.handle("DELETE", "/odata/Probes(1)")
    assert refused.status == 405 and refused.headers["Allow"] == "GET, POST"
    assert "kind" in s.query("SensorKinds").columns and s.handle("POST", "/odata/SensorKinds", body={"kind": "x"}).status == 405


def test_stream(spark, tmp_path):
    from odata_spark.streaming import stream_query

    schema, rows = TABLES["Reading"]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    spec = EntitySpec("Reading", ("id",), lambda s: s.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    out = stream_query(Registry(spark, [spec]), "Readings", {"$filter": "level gt 2 and valid eq true", "$select": "level"})
    q = out.writeStream.format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.level) for r in spark.sql("select * from levels").collect()) == [(1, 2.5), (2, 3.75)]
