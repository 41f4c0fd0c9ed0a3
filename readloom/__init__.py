"""Sequence analytics as Spark DataFrame operators.

``functions``  column expressions (strand, k-mers, qualities, statistics)
``sources``    FASTQ scan, correction and FASTQ sinks
``operators``  DataFrame in, DataFrame out
``plans``      compositions: dataset statistics, read correction
"""
