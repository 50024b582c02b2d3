from pricelens.llm.graph import components


def test_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and all(got[i] == 200 for i in range(200, 203))


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
