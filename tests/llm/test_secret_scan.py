import base64
import hashlib
import random
import re
import uuid

from pyspark.sql import functions as F

from chromloom.llm import queries as q
from chromloom.llm.secret_scan import redacted, scan_secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    """(start, kind number, end) of the three patterns, as they are written down."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def expected(doc_id, text):
    base = plain_base(text or "")
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
    return doc_id, *(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(told.encode()).hexdigest(), told


def check(rows, found):
    want = sorted((expected(*r) for r in rows), key=str)
    got = sorted(((x["doc_id"], x["n_assign"], x["n_access"], x["n_hex"], x["base_sha256"], ",".join(s for s in x["spans"].split(",") if not s.startswith("random"))) for x in found), key=str)
    assert got == want


def test_base_findings_of_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = q.op12_secret_scan(spark, sf).collect()
    check(rows, found)
    assert sum(x["n_assign"] for x in found) > 5
    # plain prose, card numbers and long words are no random strings
    assert sum(x["n_random"] for x in found) == 0


def test_odd_texts(spark, tmp_path):
    r = random.Random(3)
    pieces = ["password", "Passwd=", "token", "secret", "API_KEY: ", "apikey", "'", '"', ":", "=", "  ", "abcdefgh", "abc", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "f" * 32, "é", "\U0001f600", "ſecret=abcdefghijk", "toKen=abcdefghijk", "\n", "."]
    rows = [(i, "".join(r.choices(pieces, k=r.randrange(30)))) for i in range(600)]
    rows += [(None, None), (None, "token=abcdefgh1"), (1, "x"), (1, "x"), (700, "token=secret: abcdefghij"), (701, "word " * 60_000 + "AKIA" + "Z" * 40)]
    rows += [(702, "-" * 50_000 + "!"), (703, "aB1" * 40_000), (704, "Ab-" * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, q.op12_secret_scan(spark, str(tmp_path)).collect())


def strings(r):
    raw = lambda n: bytes(r.randrange(256) for _ in range(n))
    secrets = [base64.b64encode(raw(24)).decode() for _ in range(60)] + ["ghp_" + "".join(r.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789", k=36)) for _ in range(60)]
    clean = [hashlib.sha1(raw(8)).hexdigest().upper() for _ in range(20)] + [str(uuid.UUID(bytes=raw(16))) for _ in range(20)] + ["sha256-" + base64.b64encode(raw(32)).decode() for _ in range(20)]
    clean += ["internationalization", "getElementsByClassNameFromDocument", "2024-05-06-12-30-45-000123", "user_profile_settings_page_2", "/usr/local/share/applications/index", "customer-000123456789", "x" * 60, "1234567890" * 4, "Donaudampfschifffahrtsgesellschaft"]
    return secrets, clean


def test_random_strings_are_told_from_digests_and_identifiers(spark):
    secrets, clean = strings(random.Random(12))
    docs = spark.createDataFrame([(i, f"see {s} there", s) for i, s in enumerate(secrets + clean)], "doc_id long, text string, own string").withColumn("findings", F.lit(1))
    found = {x["doc_id"]: x for x in scan_secrets(docs, q.RANK_FILE).withColumn("safe", redacted(F.col("text"), F.col("findings"))).collect()}
    caught = [i for i in range(len(secrets)) if [f["kind"] for f in found[i]["findings"]] == ["random"]]
    assert len(caught) >= 0.97 * len(secrets)
    for i in caught:
        assert found[i]["safe"] == "see [secret] there" and found[i]["findings"][0]["ratio"] < 2.2
        assert found[i]["text"][found[i]["findings"][0]["start"] : found[i]["findings"][0]["end"]] == secrets[i]
    for i in range(len(secrets), len(secrets) + len(clean)):
        assert not [f for f in found[i]["findings"] if f["kind"] == "random"], found[i]["own"]


def test_redaction_and_empty_table(spark):
    text = "a password='abcdefgh12' and token=" + "0f" * 20 + " é end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    out = {x["doc_id"]: x["safe"] for x in scan_secrets(docs, q.RANK_FILE).withColumn("safe", redacted(F.col("text"), F.col("findings"))).collect()}
    assert out == {1: "a [secret]' and [secret] é end", 2: None, 3: "plain"}
    assert scan_secrets(docs.limit(0), q.RANK_FILE).count() == 0
