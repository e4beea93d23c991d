"""Pattern grammar, its spelling for the JVM, many patterns at once, nested JSON values, pieces of long lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.functions import patterns
from emberline.functions.basics import bind
from emberline.functions.jsonlines import go_value_string, json_object
from emberline.operators import detect as D
from emberline.operators.many import detect_many
from emberline.sources import tail, text

VALID = [
    "", "a", "foo(?i)bar", r"a\z", r"\Aa", r"\pL+", r"\p{Greek}x", r"\P{Lu}", r"\p{^Lu}", "[[:alpha:]_]", "[^[:digit:]]", "(?P<n>a)b",
    "(?<n>a)b", "(?i:a)", "(?-i)a", "(?s).", "(?U)a+?", "a{2}", "a{2,}", "a{2,3}?", "{", "a{,2}", "x{a}", r"\Qa+(\E", r"\x41\x{263a}\101",
    "[]a]", "[^]]", "[a-]", "[-a]", r"[\]\-\d]", "(|a)", "(a|b|)*", "(?:a*)*", "^*a", r"\bx\B", "a||b", "[a&&b]", "[a[b]", r"\.\_\-",
]
INVALID = [
    "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", "(?#x)", "(?x)a", "(?P=n)", r"(a)\1", r"\8", r"\k<n>", r"\Z", r"\G", r"\C", r"\h", "a\\",
    "*a", "a**", "a++", "a?+", "a{2}{3}", "a|*", "(*a)", "(", ")", "(a", "a)", "[", "[a", "[]", "[z-a]", "[[:alfa:]]", r"\p{", r"\pX1"[:3], r"\p{lower}",
    "a{1001}", "a{3,2}", "(?:a{50}){50}", "(?P<n>a)(?P<n>b)", "(?P<1-a>b)", "(?P<>a)", r"\x{110000}", r"\xZZ", "(?)", "(?i-)"[:4] + "i",
]


@pytest.mark.parametrize("pattern", VALID)
def test_valid(pattern):
    assert patterns.problem(pattern) is None


@pytest.mark.parametrize("pattern", INVALID)
def test_invalid(pattern):
    assert patterns.problem(pattern)
    with pytest.raises(ValueError):
        patterns.to_java(pattern)


def test_same_matches_as_python(spark):
    """Patterns that Python's engine reads the same way, over random texts, in one query."""
    rng = random.Random(5)
    pieces = ["a", "b", "A", ".", "[ab]", "[^a-c]", r"\d", r"\w", r"\W", "(?:a|bc)", "x{2}", "(?i:aB)", r"\.", "[[.]", "[&&]", "a-", "$", "^", r"\bb", "(a|)", "c+?", r"[\d_]"]
    made = ["".join(rng.choice(pieces) + rng.choice(["", "", "", "*", "+", "?", "{1,2}"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    def python_reads(pattern):
        try:
            return re.compile(pattern)
        except re.error:  # it has a few limits of its own
            return None

    usable = [p for p in made if patterns.problem(p) is None and python_reads(p.replace("$", r"\Z"))]
    assert len(usable) > 40
    texts = ["".join(rng.choice("abcABx1_.-[& é") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(*[F.col("t").rlike(patterns.to_java(p)).alias(f"p{i}") for i, p in enumerate(usable)]).collect()
    for t, row in zip(texts, got, strict=True):
        for i, p in enumerate(usable):
            spelt = p.replace("$", r"\Z")
            assert row[i] == bool(re.search(spelt, t, re.ASCII)), (p, t)


@pytest.mark.parametrize("pattern,want", [
    ("error", {"error"}), ("(?i)Error|WARN", {"error", "warn"}), ("ab?c", {"a"}), ("a(bc)+", {"bc"}), ("x*", None), ("foo.*longer", {"longer"}),
    ("(a|b*)c", {"c"}), ("(foo|b[ar])", {"foo", "b"}), ("[ab]", None), ("disk (sda|sdb) fail", {"disk "}), (r"user=\d+ gone", {"user="}),
])
def test_required_literals(pattern, want):
    got = patterns.required(pattern)
    assert got == (want and frozenset(want))


def test_many_monitors(spark):
    rng = random.Random(3)
    monitors = [{"name": f"m{i}", "pattern": rng.choice([f"code={i}", f"(?i)CODE={i}$", f"id[0-9]+ code={i}|fatal {i}", f"[x-z]{i}"]),
                 "exclude_pattern": rng.choice(["", "", "skip"])} for i in range(300)]
    monitors += [{"name": "web", "format": "nginx"}, {"name": "js", "format": "json", "pattern": "level:er+or"}, {"name": "all", "pattern": "."}]
    rows = [("s", i, rng.choice([f"id{i} code={i % 320}", f"Code={i % 300}", f"fatal {i % 90} skip", f"y{i % 40}", '{"level":"error"}', "[crit] x", "", None, "İ code=7"])) for i in range(250)]
    lines = spark.createDataFrame(rows, "source string, line_no long, line string")
    every = lines.crossJoin(spark.createDataFrame([(m["name"],) for m in monitors], "monitor string"))
    told = lambda df: sorted(map(str, df.select("monitor", "source", "line_no", "line", "ts", "ts_str", "n_bytes").collect()))
    got = told(detect_many(lines, monitors))
    assert got == told(D.detect_all(every, monitors)) and len(got) > 300
    with pytest.raises(ValueError):
        detect_many(lines, [{"name": "k", "type": "dmesg"}])
    with pytest.raises(ValueError):
        detect_many(lines, [{"name": "k", "pattern": "a"}] * 2)


NESTED = [
    ('{"v":{}}', "map[]"), ('{"v":[]}', "[]"), ('{"v":{"b":1,"a":[true,null,"x y"]}}', "map[a:[true <nil> x y] b:1]"),
    ('{"v":[1.50,-2e3,12345678,{"z":{"y":[[]]}}]}', "[1.5 -2000 1.2345678e+07 map[z:map[y:[[]]]]]"),
    ('{"v":["q\\"uo\\\\te","{[,:]}","\\u00e9\\n"]}', '[q"uo\\te {[,:]} é\n]'), ('{"v":{"":"","null":"null"}}', "map[: null:null]"),
]


def test_nested_values(spark):
    df = spark.createDataFrame([(x,) for x, _ in NESTED], "line string").coalesce(1)
    got = [r.v for r in df.select(bind(json_object("line"), lambda o: go_value_string(o, "v")).alias("v")).collect()]
    assert got == [want for _, want in NESTED]


def test_pieces_of_long_lines(spark, tmp_path):
    """Batch and stream cut alike, whole characters, nothing lost."""
    rng = random.Random(2)
    lines = ["".join(rng.choice("aé漢🙂 ") for _ in range(n)) for n in (0, 1, 9, 10, 11, 40, 100, 333)] + ["x" * 10, "x" * 30, "y" * 31 + "\r"]
    (tmp_path / "a.log").write_bytes(("\n".join(lines) + "\n").encode())
    read = text.read_pieces(spark, str(tmp_path / "a.log"), "app", limit=10).orderBy("line_no").collect()
    want = [(k, p.decode()) for x in lines for k, p in enumerate(tail.pieces(x.removesuffix("\r").encode(), 10))]
    assert [(r.piece, r.line) for r in read] == want
    assert all(len(r.line.encode()) < 14 for r in read)
    assert "".join(r.line for r in read) == "".join(lines).replace("\r", "")
    assert len({r.line_no for r in read}) == len(read)
