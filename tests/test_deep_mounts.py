from gristmill.operators import routes


def test_chains_of_over_64_mounts(spark):
    mounts = spark.createDataFrame([(f"r{i}", f"r{i + 1}", "/a") for i in range(66)], "parent string, child string, prefix string")
    assert max(len(r.through) for r in routes.chains(mounts).where("receiver = 'r66'").collect()) == 66
