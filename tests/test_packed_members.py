"""Members of bodies that hold several records, an array, or a cut-off one."""

from tallyglass.plans import release


def test_every_complete_record_counts_by_its_own_name(spark):
    one = lambda name, sha: '{"file": "%s", "sha256": "%s"}' % (name, sha)
    rows = [
        ("a", one("a", "1")), (None, one("b", "2") + "\n" + one("c", "3")), ("d", "[" + one("d", "4") + ", " + one("e", "5") + "]"),
        ("f", one("f", "6") + '\n{"file": "g", "sha'), ("h", '{"file": "h", "sh'), ("a", one("a", "9")), ("b", one("b", "2")), (None, None), ("i", '{"file": "i"}'),
    ]
    got = {tuple(r) for r in release.packed_digests(spark.createDataFrame(rows, "file string, body string")).collect()}
    assert got == {("a", "1"), ("a", "9"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"), ("f", "6"), ("h", None), ("i", None)}
