import math

from pyspark.sql import functions as F

from pointloom.exprs import erf, lgamma, phi_cdf


def test_lgamma_erf_phi(spark):
    xs = [1e-3, 0.3, 1.0, 2.0, 7.5, 100.0, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("v"))
    for r in df.collect():
        assert abs(r["v"] - math.lgamma(r["x"])) <= 1e-11 * max(1, abs(r["v"]))
    zs = [-6.0, -3.0, -2.9, -0.5, 0.0, 0.1, 1.0, 2.999, 3.0, 3.5, 5.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", erf(F.col("z")).alias("e"), phi_cdf(F.col("z")).alias("p"))
    for r in df.collect():
        assert abs(r["e"] - math.erf(r["z"])) < 1e-13
        assert abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-13
