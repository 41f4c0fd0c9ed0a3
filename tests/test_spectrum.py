from readloom.operators.kmers import valley_and_peak


def _marks(spark, rows):
    return valley_and_peak(spark.createDataFrame(rows, "multiplicity bigint, n_kmers bigint")).first()


def test_valley_and_peak_use_present_neighbours(spark):
    row = _marks(spark, [(1, 90), (2, 10), (5, 4), (9, 20), (12, 50), (13, 7), (20, 8)])
    assert (row.valley_index, row.valley_multiplicity, row.kmer_cov, row.peak_kmers) == (2, 5, 12, 50)


def test_plateau_and_tie(spark):
    row = _marks(spark, [(1, 9), (2, 3), (3, 3), (4, 8), (5, 2), (6, 8), (7, 1)])
    assert (row.valley_index, row.kmer_cov) == (1, 4)


def test_without_valley(spark):
    for rows in ([(1, 5)], [(1, 5), (2, 3)], [(1, 1), (2, 2), (3, 3), (4, 4)]):
        row = _marks(spark, rows)
        assert row.valley_index is None and row.kmer_cov is None
