"""Recovery cases and the ordered partition of reconnect intents."""

from pyspark.sql import functions as F

from tidemark.operators.recovery import partition_intents, recovery_case


def test_cases(spark):
    rows = [
        (None, None, None, "ABSENT", True, "CASE_D"), ("SEALED", "COPYING", "REMOTE_DELETED", "ABSENT", True, "IMPOSSIBLE_OVERLAP"), ("ACTIVE", None, "REMOTE_DELETED", "ABSENT", True, "IMPOSSIBLE_OVERLAP"),
        ("SEALED", "COPYING", None, "UNKNOWN", False, "NORMAL"), ("ACTIVE", None, None, "ABSENT", True, "CASE_D"), ("SEALED", None, None, "PRESENT_MATCHING", True, "NORMAL"), ("SEALED", None, None, "ABSENT", True, "CASE_C"),
        ("SEALED", None, None, "PRESENT_MISMATCH", True, "CASE_D"), ("SEALED", None, None, "ABSENT", False, "CASE_D"), ("SEALED", None, "REMOTE_DELETE_PENDING", "PRESENT_MATCHING", True, "CASE_A"),
        ("SEALED", None, "REMOTE_DELETE_PENDING", "ABSENT", True, "CASE_B"), ("SEALED", None, "REMOTE_DELETE_PENDING", "UNKNOWN", True, "CASE_D"), ("SEALED", None, "REMOTE_DELETED", "ABSENT", True, "TERMINAL_ABSENT"),
        ("SEALED", None, "REMOTE_DELETED", "PRESENT_MISMATCH", True, "TERMINAL_PRESENT_CONTRADICTION"), ("SEALED", None, "REMOTE_DELETED", "UNKNOWN", True, "CASE_D"), ("SEALED", None, "ODD", "ABSENT", True, "CASE_D"),
    ]
    df = spark.createDataFrame(rows, "c string, s string, r string, o string, e boolean, want string")
    got = df.select("want", recovery_case(*(F.col(x) for x in "csroe")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_intents_in_order(spark):
    intents = [(1, "g", "a", 1, 5, False), (2, "g", "a", 1, None, False), (3, "g", "b", 2, None, False), (4, "h", "c", 3, 1, False), (5, "closed", "d", 1, None, False)]
    df = spark.createDataFrame([(i, "m", "s", g, c, n, f, v) for i, g, c, n, f, v in intents] + [(6, "m", "t", "x", "q", 7, None, False), (7, "m", "u", "y", "q", 8, None, False)], "transition_id int, market string, stream string, gap_id string, connection string, generation int, trusted_frames int, versioned boolean")
    life = spark.createDataFrame([("m", "s", "closed", "CLOSED")], "market string, stream string, gap_id string, state string")
    done = spark.createDataFrame([("m", "t", "q", 7)], "market string, stream string, new_connection string, new_generation int")
    got = {r.transition_id: r.decision for r in partition_intents(df, life, done).collect()}
    assert got == {1: "proven_legitimate", 2: "open_validated", 3: "conflict", 4: "competing_open", 5: "historical_closed", 6: "proven_legitimate", 7: "ambiguous"}
