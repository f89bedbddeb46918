import hashlib
import random
import re

from affinade.llm import queries, secrets

SF = "/root/testdata/sf0.01"
# The contract's patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def base(text):
    text = text or ""
    a = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    b = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    c = [m.span() for m in HEX.finditer(text) if len(m[0]) >= 16]
    return a, b, c


def weak(text, scope=200):
    """The linking by brute force: every part against every other."""
    text = text or ""
    a, b, c = base(text)
    parts = [(*s, "assign") for s in a] + [(*s, "access") for s in b] + [(*s, "hex") for s in c]
    for kind, pattern in secrets.WEAK.items():
        parts += [(*m.span(), kind) for m in re.finditer(pattern, text, re.ASCII)]
    out = []
    for s, e, kind in parts:
        if not kind.startswith("weak_"):
            continue
        own = secrets.PART[kind]
        near = {secrets.PART[k] for s2, e2, k in parts if secrets.PART[k] != own and s2 <= e + scope and e2 >= s - scope}
        need = {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}[own]
        if need <= near:
            out.append((s, e, kind))
    return out


def brute(doc_id, text):
    a, b, c = base(text)
    parts = sorted([(s, 0, e, "assign") for s, e in a] + [(s, 1, e, "access") for s, e in b] + [(s, 2, e, "hex") for s, e in c])
    every = sorted(parts + [(s, secrets.RANK[k], e, k) for s, e, k in weak(text)])
    text_of = lambda xs: ",".join(f"{k}:{s}:{e}" for s, _, e, k in xs)
    return doc_id, len(a), len(b), len(c), hashlib.sha256(text_of(parts).encode()).hexdigest(), text_of(every)


def cases():
    rng = random.Random(5)
    bits = ["password=", "Secret: '", "API_KEY = ", "apikey=", "token:secret:abcdefghijklmnop", "abcdefABCDEF0123456789", "AKIA" + "Z" * 15, "AKIAAKIA12", "0123456789abcdef", "deadbeef", " ", "\n", "é", "ſecret=aaaaaaaaaaaaaaa", "toKen==aaaaaaaaaaaa", "日本", "https://host.example/x", "user: bob", "login=alice", "Q1w2E3r4T5y6U7i8O9p0A1s2D3f4G5h6J7k8", "x" * 150, "tokens", "passwd\":\"q.q/q+q=q-q_q", "client_id=abc123 "]
    out = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    return out + [(300, None), (301, ""), (300, None), (None, "password=abcdefghijkl"), (302, "a" * 200_000 + " AKIA" + "B" * 20), (303, "𝒳 token=" + "z" * 12 + " 𝒳 user=bob12")]


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as start", "3 as weak", "4 as assign")
    got = sorted(repr(tuple(r)) for r in secrets.digest(secrets.scan(df)).collect())
    assert got == sorted(repr(brute(*r)) for r in rows)
    assert any("weak_endpoint" in r for r in got) and any("weak_id" in r for r in got) and any("weak_secret" in r for r in got)


def test_op5_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op5_secret_scan(spark, SF).collect()))
    assert got == sorted(brute(*r) for r in rows)


def test_redaction(spark):
    rows = [(1, "a password=abcdefghijkl b", "x", 25), (2, "nothing", None, 7), (3, None, "y", None), (4, "AKIA" + "B" * 20 + " 𝒳 0123456789abcdef", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = secrets.redact(df)
    assert out.columns == df.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, "a [SECRET] b", "x", 12), (2, "nothing", None, 7), (3, None, "y", None), (4, "[SECRET] 𝒳 [SECRET]", "x", 19)]))


def test_redaction_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x token=abcdefghijkl", "p", 3)], "doc_id long, text string, assign string, weak int")
    assert [tuple(r) for r in secrets.redact(df).collect()] == [(1, "x [SECRET]", "p", 3)]


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.digest(secrets.scan(df)).count() == 0
    plan = secrets.digest(secrets.scan(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_parts_right_after_an_equals_sign_long_or_short(spark):
    """Expectations written by hand: what of each text is marked, apart from any pattern of the module."""
    forty, long_key, jwt = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12", "aB3+" * 21 + "xY==", "eyJhbGciOi1" * 20
    texts = [
        (f"AKIA{'Q' * 16}\naws_secret_access_key={forty} end", [f"AKIA{'Q' * 16}", forty]),
        (f"AKIA{'Q' * 16}\naws_secret_access_key = {forty} end", [f"AKIA{'Q' * 16}", forty]),
        (f"AccountName: store1 login=alice;AccountKey={long_key};x", ["login=alice", long_key]),
        (f"user: bob bearer {jwt}.", ["user: bob", jwt]),
        ("db user=bob password=hunter2 at postgres://db.example/x now", ["user=bob", "password=hunter2", "postgres://db.example/x"]),
        ("user=bob&password=p@ss!&at=mongodb+srv://db.example", ["user=bob", "password=p@ss!", "mongodb+srv://db.example"]),
        ("user: bob 'passwd': 'a' HTTPS://db.example", ["user: bob", "passwd': 'a", "HTTPS://db.example"]),
        ("password=hunter2 at postgres://db.example/x", []),  # no identifier
        (f"user=bob {'x' * 250} password=hunter2", []),  # out of scope
        (f"key={long_key} at ftp://db.example", []),  # no identifier
        ("user=bob at redis://db.example/0", []),  # no secret
        ("password=hunter2hunter2", ["password=hunter2hunter2"]),  # the base alone
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    for i, (text, want) in enumerate(texts):
        places = [tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s]
        assert sorted({text[a:b] for a, b in places}) == sorted(want), text
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for i, (text, want) in enumerate(texts):
        for part in sorted(want, key=len, reverse=True):
            text = text.replace(part, "[SECRET]")
        assert clean[i] == text


def test_long_runs_cost_no_square(spark):
    text = "a1" * 300_000 + " " + "Ab1" * 100_000 + " user=bob x://abcdef"
    (row,) = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert row["spans"] == "hex:0:600000,weak_secret:600001:900001,weak_id:900002:900010,weak_endpoint:900011:900021"


def test_overlapping_spans_are_marked_once(spark):
    """A long span over many short ones, and spans at a block's border."""
    long_one = "Zz9+" + "+".join(["0123456789abcdef"] * 30)
    texts = [f"user=bob {long_one} end", "x" * 980 + " password=abcdefghijkl " + "y" * 2100 + " token=zyxwvutsrqpo", "é" * 1000 + "0123456789abcdef" + "𝒳" * 999]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert got == {0: "[SECRET] [SECRET] end", 1: "x" * 980 + " [SECRET] " + "y" * 2100 + " [SECRET]", 2: "é" * 1000 + "[SECRET]" + "𝒳" * 999}


def test_many_secrets_cost_no_square(spark):
    """A text of a million characters with 45,000 secrets."""
    import time

    text = "password=abcdefghijkl " * 45_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    (row,) = secrets.digest(secrets.scan(df)).collect()
    assert row["n_assign"] == 45_000 and row["spans"].endswith("assign:989978:989999")
    (clean,) = secrets.redact(df).collect()
    assert clean["text"] == "[SECRET] " * 45_000 and time.time() - begin < 60
