"""How many items of an answer are taken."""

import json

from vernissage.plans import answers


def test_items_are_cut_or_refused_only_where_a_number_is_given(spark):
    shows = [json.dumps({"title": f"t{i}"}) for i in range(45)]
    made = [json.dumps({"exhibitions": [json.loads(s) for s in shows]})]
    df = spark.createDataFrame([(1, True, made), (2, False, made)], "page_id long, listing boolean, tool_inputs array<string>").selectExpr(
        "*", "0 as link_count", "date'2024-01-01' as fetched_on", "cast(null as array<struct<number:int,url:string>>) as links")
    got = lambda most: {r.page_id: (len(r.exhibitions), r.capped, r.reason) for r in answers.read_answers(df, most).collect()}
    assert got(None) == {1: (45, False, None), 2: (45, False, None)}
    assert got(40) == {1: (40, True, None), 2: (45, False, "too many items")}
    assert got(45) == {1: (45, True, None), 2: (45, False, None)}
