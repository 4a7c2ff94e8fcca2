"""Strict edits of single files, and totals of previews."""

from twinspark.operators import compare, edits, views

FILES = "repo string, repo_ord int, rel_path string, size long, hash string, modified_ms long, missing boolean, mime string, origin string, img_w int, img_h int, taken_ms long, camera string"
REQUESTS = "n long, op string, from_repo string, from_rel string, to_repo string, to_rel string, outcome string"


def table(spark, *rows):
    return spark.createDataFrame([(r, int(r[-1]), p, 5, c, 1, m, None, None, None, None, None, None) for r, p, c, m in rows], FILES)


def asked(spark, *rows):
    return spark.createDataFrame([(n, *r, None) for n, r in enumerate(rows)], REQUESTS)


def base(spark):
    return table(spark, ("r0", "a", "1", False), ("r0", "b", "2", False), ("r0", "old", "3", True), ("r1", "a", "9", False), ("r1", "tomb", "8", True))


def outcome(spark, *request):
    return edits.outcomes(base(spark), asked(spark, request)).first()["outcome"]


def test_refusals(spark):
    assert outcome(spark, "rename", "r0", "a", None, "new/x") == "done"
    assert outcome(spark, "rename", "r0", "a", "r1", "a") == "same"  # a rename stays in its repository
    assert outcome(spark, "rename", "r0", "a", None, "b") == "already_exists"
    assert outcome(spark, "rename", "r0", "old", None, "x") == outcome(spark, "rename", "r0", "none", None, "x") == "no_such_file"
    assert outcome(spark, "rename", "r0", "a", None, "old") == "done"  # only a missing entry is there
    for path in ("../x", "/x", " ", "", None, "d/../../x"):
        assert outcome(spark, "copy", "r0", "a", "r1", path) == "invalid_path"
        assert outcome(spark, "delete", "r0", path, None, None) == "invalid_path"
    assert outcome(spark, "copy", "r0", "a", "r1", "a") == "already_exists"
    assert outcome(spark, "overwrite", "r0", "a", "r1", "a") == "done"
    assert outcome(spark, "copy", "r0", "a", "r0", "a") == outcome(spark, "overwrite", "r0", "a", "r0", "a") == "same"
    assert outcome(spark, "delete", "r0", "old", None, None) == "done" and outcome(spark, "delete", "r0", "none", None, None) == "no_such_file"
    assert outcome(spark, "shred", "r0", "a", None, None) == outcome(spark, None, "r0", "a", None, None) == "unknown_op"


def test_requests_on_one_path(spark):
    rows = asked(spark, ("copy", "r0", "a", "r1", "x"), ("copy", "r0", "a", "r1", "y"), ("rename", "r0", "a", None, "z"), ("copy", "r0", "b", "r1", "x"), ("delete", "r0", "b", None, None))
    got = [r["outcome"] for r in edits.outcomes(base(spark), rows).orderBy("n").collect()]
    # Two copies read one file; it cannot be renamed under them.  The second copy to x loses, and holds b against the delete.
    assert got == ["done", "done", "conflict", "conflict", "conflict"]


def test_catalogue_after_edits(spark):
    rows = asked(spark, ("rename", "r0", "a", None, "old"), ("overwrite", "r0", "b", "r1", "a"), ("copy", "r0", "b", "r1", "tomb"), ("delete", "r0", "none", None, None))
    got = sorted((r["repo"], r["repo_ord"], r["rel_path"], r["hash"], r["missing"], r["origin"]) for r in edits.edited(base(spark), rows).collect())
    assert got == [("r0", 0, "b", "2", False, None), ("r0", 0, "old", "1", False, None), ("r1", 1, "a", "2", False, "r0"), ("r1", 1, "tomb", "2", False, "r0")]
    gone = edits.edited(base(spark), asked(spark, ("delete", "r0", "a", None, None))).where("rel_path = 'a' AND repo = 'r0'").collect()
    assert [r["missing"] for r in gone] == [True]
    assert sorted(map(tuple, edits.edited(base(spark), asked(spark).where("false")).collect())) == sorted(map(tuple, base(spark).collect()))


def test_totals_of_copies_and_moves(spark):
    source = table(spark, ("r0", "a", "1", False), ("r0", "b", "2", False), ("r0", "c", "3", False), ("r0", "d", "4", True))
    known = compare.classified(source, table(spark, ("r1", "x", "2", False), ("r1", "y", "3", True)))
    assert tuple(views.transfer_totals(known).first()) == (1, 5, 0, 1, 1)
    assert tuple(views.transfer_totals(known, move=True).first()) == (1, 5, 1, 1, 1)
    assert tuple(views.transfer_totals(known.where("false"), move=True).first()) == (0, 0, 0, 0, 0)
