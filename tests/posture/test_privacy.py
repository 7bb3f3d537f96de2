"""Addresses, names and leaves against definitions in plain Python."""

import ipaddress
import json
import random
import re

from pyspark.sql import functions as F

from mailward.functions import privacy
from mailward.operators import leaves


def each(spark, texts, build):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in rows.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


def sound(address):
    try:
        return ipaddress.ip_address(address).exploded
    except ValueError:
        return None


def test_ipv6(spark):
    rng = random.Random(1)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":::", "1:::2", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "::ffff", "ABCD:ef::1", "12:30:45", "g::1"]
    texts += ["".join(rng.choice(["1", "ab", ":", ":", "::", "f0f0"]) for _ in range(rng.randint(2, 12))) for _ in range(400)]
    for text, got in zip(texts, each(spark, texts, privacy.ipv6_forms), strict=True):
        wanted = [sound(r) for r in re.findall("[0-9A-Fa-f:]+", text) if 2 <= r.count(":") <= 7]
        assert got == [w for w in wanted if w], text


def odd(host):
    """By the ways to write an IPv4 address: one to four parts, each hexadecimal, octal or decimal, the last one filling the rest."""
    parts = host.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts):
        return any(str(int(p)) != p or int(p) > 255 for p in parts)
    if not 2 <= len(parts) <= 4:
        return False
    total = []
    for p in parts:
        try:
            total.append(int(p, 0 if p[:2].lower() == "0x" else 8 if p[:1] == "0" and len(p) > 1 else 10) if re.fullmatch("0[xX][0-9a-fA-F]+|[0-9]+", p) else -1)
        except ValueError:
            return False
    return min(total) >= 0 and all(v < 256 for v in total[:-1]) and total[-1] < 256 ** (5 - len(parts))


def test_odd_ipv4(spark):
    rng = random.Random(2)
    texts = ["127.0.0.1", "0x7f.1", "010.1.1.1", "256.1.1.1", "1.2.3", "1.65536", "1.16777215", "1.16777216", "08.1", "0x.1", "1", "0x7f000001", "1.2.3.0x100", "99999999999999999999.1", "0xfffffffffffffffff.1", "1..2", "", "a.b", "0.0.0.0", "00.0.0.0", "1.0x00000000ff"]
    texts += [".".join(rng.choice(["0", "1", "255", "256", "010", "0x1F", "0377", "65535", "65536", "16777215", "8", "09"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    assert each(spark, texts, privacy.odd_ipv4) == [odd(t) for t in texts]


def named(text):
    """Label by label: runs between dots, cut where a label may not stand."""
    out = []
    for run in re.split(r"[^\w.-]+", text):
        held = []
        for label in [*run.split("."), "-"]:
            if label and len(label) <= 63 and label[0].isalnum() and label[-1].isalnum():
                held.append(label)
                continue
            try:
                ascii_ = [h.encode("idna").decode().lower() for h in held]
            except UnicodeError:
                ascii_ = []
            if len(ascii_) > 1 and len(".".join(ascii_)) <= 253 and all(re.fullmatch("[a-z0-9]([a-z0-9-]*[a-z0-9])?", a) for a in ascii_) and re.fullmatch("[a-z]{2,63}|xn--[a-z0-9-]{2,59}", ascii_[-1]):
                out.append(".".join(ascii_))
            held = []
    return out


def test_names(spark):
    rng = random.Random(3)
    texts = ["a.ch", "-a.b", "a-.bc", "x_.y.ch", "a.b_.ch", "a..bc.de", "(a.ch)", "a.ch.", ".a.ch", "mail@host.example.", "1.2", "v1.2x", "a." + "b" * 63, "a." + "b" * 64, ".".join(["a" * 50] * 6) + ".ch", "Bücher.Example x.y", "ß.de", "日本.jp and a.ch und ö.example", "a.xn--p1ai", "a.b-c.d9", "٣.٤٥"]
    texts += ["".join(rng.choice(["a", "b1", ".", ".", "-", "_", " ", "é", "ch", "/"]) for _ in range(rng.randint(2, 14))) for _ in range(400)]
    assert each(spark, texts, privacy.names_of) == [named(t) for t in texts]


def test_plain_text_and_parameters(spark):
    texts = ["%2541", "&amp;amp;lt;", "１．２", "a\\\\/b", "∕x⁄", None, "", "%zz&nope"]
    assert each(spark, texts, privacy.plain_text) == ["A", "<", "1.2", "a/b", "/x/", None, "", "%zz&nope"]
    digest = "a" * 64
    cases = [(digest, dict(hash_lengths=[64]), []), (digest, dict(hash_lengths=[40]), ["digest"]), (digest.upper(), dict(hash_lengths=[64]), ["digest"]), ("2130706433", dict(decimals=True), []), ("at 2130706433", dict(decimals=True), ["decimal_ip"]), ("see a.ch and b.ch", dict(approved=["a.ch"]), ["name"]), ("A.CH", dict(approved=["a.ch"]), []), ("::1 1.1.1.1", dict(ips=["0:0::1", "1.1.1.1"]), []), ("::2", dict(ips=["::1"]), ["ip"])]
    for text, options, want in cases:
        assert each(spark, [text], lambda c, o=options: privacy.violation_codes(c, **o)) == [want]
    assert each(spark, [None], privacy.violation_codes) == [[]]


def plain_leaves(value, path=()):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in plain_leaves(v, (*path, k))]
    if isinstance(value, list):
        return [x for v in value for x in plain_leaves(v, (*path, "*"))]
    return [(list(path), str(value))] if isinstance(value, (str, int)) and not isinstance(value, bool) else []


def test_leaves(spark):
    deep = "x"
    for i in range(30):
        deep = [deep] if i % 2 else {"k": deep, "n": i}
    values = [{"a": [{"b.c": 1}, True, None, 1.5], "": "x"}, [], {}, "text", 7, -(10**20), [[["a"]]], {"é": {"*": "y"}}, deep, [None]]
    broken = ["{", '{"a": 1, "a": 2}', '{"a": 1} x', "1 2", "1,2", "", "NaN", None]
    texts = [json.dumps(v) for v in values] + broken
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in leaves.json_leaves(rows, "i", "t").collect():
        got.setdefault(r.i, []).append((r.path, r.leaf))
    for i, v in enumerate(values):
        assert sorted(got.pop(i, [])) == sorted(plain_leaves(v)), v
    assert got == {}
    assert leaves.json_leaves(rows.limit(0), "i", "t").count() == 0


def test_allowlist(spark):
    rng = random.Random(4)
    paths = [[rng.choice("abc*") for _ in range(rng.randint(0, 4))] for _ in range(120)]
    for patterns in ([], [[]], [["*"]], [["a", "*", "b"], ["a", "b"], ["*", "*", "*", "c"]], [[rng.choice("ab*") for _ in range(rng.randint(1, 3))] for _ in range(9)]):
        want = sorted(p for p in paths if not any(len(p) == len(q) and all(y in ("*", x) for x, y in zip(p, q, strict=True)) for q in patterns))
        got = leaves.forbidden(spark.createDataFrame([(p,) for p in paths], "path array<string>"), patterns).collect()
        assert sorted(r.path for r in got) == want
