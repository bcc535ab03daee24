"""JSON intake and declared schemas."""
import json
import re

import pytest
from pyspark.sql import functions as F

from codedelta.operators import store as ST
from codedelta.sources import schemas as S
from codedelta.sources.intake import code_pairs_of, parse_requests


def test_requests_are_parsed_or_kept_with_reasons(spark):
    paste = json.dumps({"type": "paste", "content": 'a "q" \\ é\n '})
    rows = [("ok", "python", paste, paste, '{"mapHints": {"a": "b"}, "includeSecurityScan": "False"}'), ("none", None, None, paste, None),
            ("cut", "python", '{"type": "paste"', paste, "[1]"), ("scalar", "c", '"text"', "null", "{}"),
            ("empty", "c", "", '{"type": "paste", "content": ""}', '{"mapHints": null}'),
            ("repo", "c", '{"type": "repo", "url": "not a uri"}', '{"type": "repo", "url": "https://h/x.git"}', '{"runStaticChecks": 1}')]
    d = parse_requests(spark.createDataFrame(rows, "id string, language string, legacy string, refactored string, options string"))
    got = {r.id: r for r in d.collect()}
    assert got["ok"].errors == [] and got["ok"].legacy.content == 'a "q" \\ é\n ' and got["ok"].map_hints == {"a": "b"}
    assert got["ok"].include_security_scan is False and got["ok"].analyze_tests is True and got["ok"].legacy_raw is None
    assert got["none"].errors == [ST.LANGUAGE_MESSAGE, '"legacy" is required'] and got["none"].legacy is None
    assert got["cut"].errors == ['"legacy" must be of type object', '"options" must be of type object'] and got["cut"].legacy_raw == '{"type": "paste"'
    assert got["scalar"].legacy_raw == '"text"' and got["scalar"].refactored_raw == "null" and len(got["scalar"].errors) == 2
    assert got["empty"].errors == ['"legacy" must be of type object', '"refactored.content" is not allowed to be empty']
    assert got["repo"].errors == ['"legacy.url" must be a valid uri', '"options.runStaticChecks" must be a boolean']
    assert [r.pair_id for r in code_pairs_of(d).collect()] == ["ok"]
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("uri, valid", [
    ("https://github.com/a/b.git", True), ("git@github.com:a/b", False), ("ssh://git@h:22/x?y=1#z", True), ("mailto:a@b", True), ("http://a b", False),
    ("://x", False), ("http://[::1]:80/", True), ("file:///tmp/a", True), ("x", False), ("http://a/%zz", False), ("http://a/%20", True)])
def test_uris(spark, uri, valid):
    assert bool(re.match(ST.uri_pattern(), uri)) is valid
    assert spark.range(1).select(ST.is_uri(F.lit(uri))).first()[0] is valid


def test_a_long_uri_does_not_overflow(spark):
    assert spark.range(1).select(ST.is_uri(F.concat(F.lit("http://h/"), F.repeat(F.lit("a/%20"), 100000)))).first()[0] is True


def test_declared_schema_is_checked_on_read(spark, tmp_path):
    good = spark.createDataFrame([("p", "python", 1, "extra")], "pair_id string, language string, org int, more string")
    good.select("pair_id", "language", "more").write.parquet(str(tmp_path / "good"))
    rows, corrupt = S.read_declared(spark, str(tmp_path / "good"), S.CODE_PAIRS)
    assert rows.columns == [f.name for f in S.CODE_PAIRS.fields] and rows.count() == 1 and corrupt.count() == 0
    good.write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(S.SchemaMismatch, match='"org" is int, not string'):
        S.read_declared(spark, str(tmp_path / "wrong"), S.CODE_PAIRS)
    good.drop("pair_id", "org").write.parquet(str(tmp_path / "absent"))
    with pytest.raises(S.SchemaMismatch, match='"pair_id" is missing'):
        S.read_declared(spark, str(tmp_path / "absent"), S.CODE_PAIRS)
    (tmp_path / "lines.json").write_text('{"analysis_id": "a", "status": "pending", "ts": "2024-01-01T00:00:00Z", "seq": 1}\n{"analysis_id": "b"\n'
                                         '{"analysis_id": "c", "status": null, "ts": "2024-01-01T00:00:00Z"}\n{"analysis_id": "d", "status": "failed", "ts": "2024-01-01T00:00:00Z", "seq": "x"}\n')
    rows, corrupt = S.read_declared(spark, str(tmp_path / "lines.json"), S.STATUS_EVENTS, "json")
    assert [r.analysis_id for r in rows.collect()] == ["a"] and corrupt.count() == 3


def test_domain_violations(spark):
    rows = [("a", "x", 5, 1), ("b", "y", 50, 1), (None, None, None, None), ("a", "z", -1, 2), ("c", "x", 7, 3)]
    df = spark.createDataFrame(rows, "id string, kind string, v int, u int")
    got = sorted(tuple(r) for r in ST.domain_violations(df, "id", {"kind": ["x", "y"]}, {"v": (0, 10)}, ["kind"], ["id", "u"]).collect() if r.id)
    assert got == [("a", "id", "unique"), ("a", "id", "unique"), ("a", "kind", "enum"), ("a", "u", "unique"), ("a", "v", "range"),
                   ("b", "u", "unique"), ("b", "v", "range")]
    nulls = ST.domain_violations(df, "id", required=["kind"]).collect()
    assert [tuple(r) for r in nulls] == [(None, "kind", "required")]
    assert ST.domain_violations(df.filter("false"), "id", unique=["u"]).collect() == []
