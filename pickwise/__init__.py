"""pickwise: choose the best of many generated answers with weak verifiers, on Spark.

Tables in, tables out.  The canonical table is *wide*:

    scores(problem_id BIGINT, sample_idx INT, y INT, <one DOUBLE column per verifier>)

NULL means a missing score, -1.0 means an abstaining vote.  Every operator is a
lazy DataFrame -> DataFrame function; only verifier-sized statistics (tens of
numbers) ever reach the driver.
"""

__version__ = "0.1.0"
