"""Scan-request rules and defaults."""

import pytest

from sitelens.sources.requests import accepted, violations, with_defaults

OK = '"base_url":"http://x.example","wordlists":{}'

CASES = [
    ("{" + OK + "}", []),
    ("{}", ["base_url missing", "wordlists missing"]),
    ('{"base_url":"ftp://x","wordlists":{}}', ["base_url not http"]),
    ('{"base_url":"http://","wordlists":{}}', ["base_url not http"]),
    ('{"base_url":"x.example","wordlists":{}}', ["base_url not http"]),
    ("{" + OK + ',"max_depth":-1}', ["max_depth"]),
    ("{" + OK + ',"max_depth":0,"max_pages":1,"retry_times":0}', []),
    ("{" + OK + ',"max_depth":"two"}', ["max_depth"]),
    ("{" + OK + ',"max_depth":1.5}', ["max_depth"]),
    ("{" + OK + ',"max_depth":2.0}', []),
    ("{" + OK + ',"max_pages":0}', ["max_pages"]),
    ("{" + OK + ',"timeout":0}', ["timeout"]),
    ("{" + OK + ',"timeout":"soon"}', ["timeout"]),
    ("{" + OK + ',"user_agent":""}', ["user_agent"]),
    ("{" + OK + ',"rate_limit":-0.5}', ["rate_limit"]),
    ("{" + OK + ',"retry_times":-1}', ["retry_times"]),
    ("{" + OK + ',"colour":1,"size":2}', ["unknown field colour", "unknown field size"]),
    ('{"base_url":"http://x","wordlists":{"a":"missing.txt","b":"gone.txt","c":"there.txt"}}',
     ["wordlist not found"]),
    ('{"base_url":', ["not a JSON object"]),
    ("[1]", ["not a JSON object"]),
    ("null", ["not a JSON object"]),
    ('"text"', ["not a JSON object"]),
    ("{" + OK + ',"timeout":null,"user_agent":null}', ["timeout", "user_agent"]),
    ('{"base_url":null,"wordlists":{}}', ["base_url not http"]),
    ('{"base_url":"http://x","wordlists":["a"]}', ["wordlists"]),
    ('{"base_url":"http://x","wordlists":null}', ["wordlists"]),
    ("{" + OK + ',"localization":null}', ["localization"]),
    ("{" + OK + ',"localization":[]}', ["localization"]),
    ("{" + OK + ',"localization":{}}', []),
    ("{" + OK + ',"localization":{"fr":{"subdomain":"fr."}}}', ["localization"]),
    ("{" + OK + ',"localization":{"fr":{"subdomain":"fr.","path_prefix":"/fr","hreflangs":"fr"}}}', ["localization"]),
    ("{" + OK + ',"localization":{"fr":{"subdomain":"fr.","path_prefix":"/fr","hreflangs":["fr"]}}}', []),
]


@pytest.mark.parametrize("request_json, want", CASES)
def test_rules(spark, request_json, want):
    requests = spark.createDataFrame([("s", request_json)], "site STRING, request STRING")
    catalogue = spark.createDataFrame([("there.txt",)], "path STRING")
    assert sorted(r.rule for r in violations(requests, catalogue, "site").collect()) == want


def test_defaults(spark):
    rows = [("a", "{" + OK + "}"), ("b", "{" + OK + ',"max_depth":2.0,"timeout":2,"user_agent":"T"}')]
    got = with_defaults(spark.createDataFrame(rows, "site STRING, request STRING")).orderBy("site").collect()
    assert tuple(got[0]) == ("a", "http://x.example", 3, 1000, 10.0, "SiteLensBot/1.0", 1.0, 3)
    assert tuple(got[1]) == ("b", "http://x.example", 2, 1000, 2.0, "T", 1.0, 3)


def test_only_sound_requests_are_accepted(spark):
    rows = [(1, "a", "{" + OK + "}"), (2, "b", '{"base_url":'), (3, "c", "{" + OK + ',"max_pages":0}')]
    df = spark.createDataFrame(rows, "id INT, site STRING, request STRING")
    catalogue = spark.createDataFrame([], "path STRING")
    assert [(r.id, r.site, r.max_depth) for r in accepted(df, catalogue, "id").collect()] == [(1, "a", 3)]
