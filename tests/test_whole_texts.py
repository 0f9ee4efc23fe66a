import __spark_entry__ as entry


def test_whole_regions_and_texts(spark, tmp_path):
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_linestatus string, l_extendedprice double, l_quantity double, l_returnflag string, l_discount double"
    starts = (0.0, 30.0, 85.0, 300.0)  # within 90 residues, within, over the end, behind it
    spark.createDataFrame([(k, 1, 7, 3, "O", s, 5.0, "A", 0.05) for k, s in enumerate(starts)], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "abcde fghij")], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["p38_sequence_agreement_all"](spark, str(tmp_path)).collect()
    assert [(x["n_same"], x["n"]) for x in got] == [(2, 4)]
    spark.createDataFrame([(1, "word " * 40, 200, "en")], "doc_id bigint, text string, n_chars bigint, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "word " * 40 in entry.queries()["p23_insert_clan_line_all"](spark, str(tmp_path)).first()["rec"]
