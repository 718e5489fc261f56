from tellstone.plans import documents

PLAYER = '{"data": [{"type": "player", "id": "p", "relationships": {"matches": {"data": [{"type": "match", "id": "m1"}, {"type": "match", "id": ""}, {"type": "match", "id": "m2"}]}, "clan": {"data": {"type": "clan", "id": "c"}}, "none": {"data": null}}}, {"type": "player", "id": "q", "relationships": {"matches": {"data": [{"type": "match", "id": "m9"}]}}}], "included": [{"type": "match", "id": "m2", "attributes": {"x": 1}}, {"type": "match", "id": "m2", "attributes": {"x": 2}}, {"type": "clan", "id": "m1"}]}'
MATCH = '{"data": {"type": "match", "id": "m"}, "included": [{"type": "participant", "id": "1", "attributes": {"URL": "no"}}, {"type": "asset", "id": "2", "attributes": {}}, {"type": "asset", "id": "3", "attributes": {"URL": "first"}}, {"type": "asset", "id": "4", "attributes": {"URL": "second"}}]}'


def rows(spark):
    return spark.createDataFrame([("a", PLAYER), ("b", MATCH), ("c", None), ("d", "not json"), ("e", '{"data": []}'), ("f", "[]")], "key string, payload string")


def test_references(spark):
    got = sorted(tuple(r)[1:] for r in documents.resolved(rows(spark), "key").collect())
    assert got == [("player", "p", "clan", 0, "clan", "c", None), ("player", "p", "matches", 0, "match", "m1", None), ("player", "p", "matches", 2, "match", "m2", '{"x":1}'), ("player", "q", "matches", 0, "match", "m9", None)]


def test_matches_and_telemetry(spark):
    assert sorted(tuple(r) for r in documents.matches_of(rows(spark), "key").collect()) == [("a", 0, "m1"), ("a", 2, "m2")]
    assert [tuple(r) for r in documents.telemetry_of(rows(spark), "key").collect()] == [("b", "first")]
