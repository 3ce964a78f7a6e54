import pytest

from shoebox.plans.catalog import Catalog


@pytest.fixture(scope="module")
def catalog(spark, data):
    return Catalog.open(spark, data)


def test_reads(catalog):
    total = catalog.status().first()["total"]
    assert total == catalog.files.count()
    assert catalog.browse(kind="photo", page_size=5).count() <= 5
    some = catalog.files.select("id").first()["id"]
    assert catalog.detail(some)["file"].count() >= 1
    with pytest.raises(KeyError):
        catalog.detail(-1)
    kinds = {r["kind"] for r in catalog.groups().select("kind").distinct().collect()}
    assert kinds <= {"exact", "near", "video"}
    assert catalog.folders().count() > 0 and catalog.people().count() == catalog.persons.count()
    with pytest.raises(ValueError):
        catalog.strangers("x", [], [])
    assert catalog.strangers("%", [17], []).columns == ["file_id", "n_faces", "closest"]
    assert catalog.search("2018").count() <= 60


def test_groups_hold_their_keeper_and_two_members(catalog):
    g = catalog.groups().toPandas()
    by = g.groupby(["kind", "group_id"])
    assert (by.size() >= 2).all() and by.apply(lambda x: x.keep_id.iloc[0] in set(x.file_id)).all()
    spare = set(g[(g.kind == "exact") & (g.file_id != g.keep_id)].file_id)
    assert not spare & set(g[g.kind != "exact"].file_id)


def test_changes_give_new_versions(catalog, spark):
    new = spark.createDataFrame([("s", "a/b.jpg", 5, "m")], "source string, path string, size long, md5 string")
    assert catalog.indexed(new, ["source", "path"], ["size"], ["md5"]).files.count() == catalog.files.count() + 1
    once = catalog.with_inherited_analysis()
    assert once.files.where("status = 'analyzed'").count() >= catalog.files.where("status = 'analyzed'").count()
    again = catalog.reclustered().faces
    assert again.count() == catalog.faces.count() and again.columns == catalog.faces.columns
