from foldloom.sources.lines import truth_lines


def test_long_truth_line(spark):
    df = spark.createDataFrame([("A1 " + " ".join(f"{k}-{k + 3}" for k in range(10_050)) + " ?",)], "line string")
    row = truth_lines(df).first()
    assert len(row["choppings"]) == 10_050 and row["excluded"]
