import random

from docsync_spark.operators import hierarchy

KIND = "id string, name string, parent string, doc_type string"


def rows_of(tree):
    return [(i, n, p, "CollectionType") for i, (n, p) in tree.items()]


def test_moves_agree_with_the_whole_listing(spark):
    for seed in range(2):
        rng = random.Random(seed)
        tree = {}
        for i in range(60):
            parent = rng.choice(["", "trash", "unknown", *[f"f{rng.randrange(70)}" for _ in range(9)]])  # cycles too
            tree[f"f{i}"] = (f" n{rng.randrange(9)}", parent if parent != f"f{i}" else "")
        paths = hierarchy.folder_paths(spark.createDataFrame(rows_of(tree), KIND))
        for _ in range(2):
            changes = []
            for i in rng.sample(range(75), 8):
                name, parent, gone = f"m{rng.randrange(9)}", rng.choice(["", "trash", *[f"f{rng.randrange(75)}" for _ in range(5)]]), rng.random() < 0.3
                changes.append((f"f{i}", name, parent, gone))
                if gone:
                    tree.pop(f"f{i}", None)
                else:
                    tree[f"f{i}"] = (name, parent)
            paths = hierarchy.move_folders(paths, spark.createDataFrame(changes, "id string, name string, parent string, deleted boolean"))
            want = hierarchy.folder_paths(spark.createDataFrame(rows_of(tree), KIND))
            plain = lambda df: sorted(((r["id"], r["name"], r["parent"], r["parts"], r["key"]) for r in df.collect()), key=repr)
            assert plain(paths) == plain(want)


def test_no_folders_and_no_changes(spark):
    none = spark.createDataFrame([], "id string, name string, parent string, deleted boolean")
    empty = hierarchy.folder_paths(spark.createDataFrame([], KIND))
    assert hierarchy.move_folders(empty, none).collect() == []
    one = hierarchy.folder_paths(spark.createDataFrame([("a", "A", "", "CollectionType")], KIND))
    assert [tuple(r) for r in hierarchy.move_folders(one, none).select("id", "parts").collect()] == [("a", ["A"])]
    new = spark.createDataFrame([("b", "B", "a", None)], "id string, name string, parent string, deleted boolean")
    assert [tuple(r) for r in hierarchy.move_folders(empty, new).select("id", "parts").collect()] == [("b", ["B"])]
