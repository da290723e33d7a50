import random

from siftline.operators.path_tree import lines, path_tree


def brute(paths):
    """(kind, depth, name, path) in order, by walking nested dicts."""
    top = {}
    for p in paths:
        *dirs, name = p.split("/")
        node = top
        for d in dirs:
            node = node.setdefault((1, d), {})
        node[0, name] = None

    def walk(node, depth, at):
        for (folder, name), below in sorted(node.items()):
            if not folder:
                yield "file", depth, name, at + name
                continue
            path = at + name
            while len(below) == 1 and next(iter(below))[0]:
                ((_, only), below), = below.items()
                name, path = f"{name}/{only}", f"{path}/{only}"
            yield "dir", depth, name, path
            yield from walk(below, depth + 1, path + "/")

    return list(walk(top, 0, ""))


def test_tree(spark):
    rnd = random.Random(4)
    paths = {"/".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 6))) + f"/f{rnd.randrange(9)}.x" for _ in range(150)}
    paths = {p.lstrip("/") for p in paths} | {"one/way/down/to/it.txt", "one/way/down/to/that.txt", "é/é.txt", "a.b/c/d"}
    # A name is a file or a directory, not both.
    files = spark.createDataFrame([(p, 1) for p in paths] + [("a.b/c/d", 1), (None, 1)], "path string, depth int").repartition(5)
    got = path_tree(files).orderBy("key").collect()
    assert [(r.kind, r.depth, r.name, r.path) for r in got] == brute(paths)


def test_lines(spark):
    rows = [("README.md", 900, "e000"), ("src/lib/a.ts", 1536, "e001"), ("src/lib/b.ts", 3 << 20, "e002"), ("src/main.ts", 5 << 30, "e003"), ("docs/x/y/z.md", 0, "e004")]
    got = lines(path_tree(spark.createDataFrame(rows, "path string, size long, tag string")), 50)
    assert got == "# e000 README.md (900 B)\n\n# docs/x/y/\n## e004 z.md (0 B)\n\n# src/\n## e003 main.ts (5.0 GB)\n\n## lib/\n### e001 a.ts (1.5 KB)\n### e002 b.ts (3.0 MB)\n"


def test_empty(spark):
    assert path_tree(spark.createDataFrame([], "path string")).collect() == []
