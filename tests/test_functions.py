import pytest
from pyspark.sql import functions as F

from codelode.functions import hashing, numeric, text
from codelode.sources import classify, lexer


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_rounding_and_shares(spark):
    r = one(spark, a=numeric.round_half_up(F.lit(-2.5)), b=numeric.round_half_up(F.lit(2.5)), c=numeric.share(F.lit(1), F.lit(0)), d=numeric.round2(F.lit(0.125)), e=numeric.token_estimate(F.lit(5)), f=numeric.token_estimate(F.lit(5), up=False))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (-2, 3, None, 0.13, 2, 1)


def test_hashes(spark):
    r = one(spark, a=hashing.fnv1a(F.lit("abc")), b=hashing.fnv1a_tokens(F.array(F.lit("if"), F.lit("("))), c=hashing.fnv1a_tokens(F.array().cast("array<string>")))
    assert r.a == 440920331
    assert r.b == lexer.fnv(["if", "("])
    assert r.c == 0x811C9DC5
    few = one(spark, s=hashing.sketch(F.split(F.lit("a b c d e"), " ")), g=hashing.grams(F.split(F.lit("a b c d e"), " ")))
    assert few.s is None
    assert few.g == ["a|b|c|d", "b|c|d|e"]
    many = one(spark, s=hashing.sketch(F.split(F.lit(" ".join(map(str, range(60)))), " "))).s
    assert len(many) == 24
    assert many == sorted(set(many))


def test_names(spark):
    r = one(
        spark,
        camel=text.camel_tokens(F.lit("HTTPServer_parseURL2json")),
        ident=text.identifier_tokens(F.lit("JSONWebToken")),
        acr=text.acronym(F.array(F.lit("json"), F.lit("web"), F.lit("token"))),
        same=text.name_similarity(F.lit("handleToken"), F.lit("processToken")),
        none=text.name_similarity(F.lit("run"), F.lit("x")),
        empty=text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")),
        parts=text.name_token_jaccard(F.lit("parseUserName"), F.lit("parse_user_id")),
        fold=text.fold_path(F.lit("a/b/../c/./d")),
        pkg=text.specifier_package(F.lit("@scope/pkg/deep")),
        stem=text.test_stem(F.lit("x/y/test_token.spec.ts")),
        code=text.code_lines(F.lit("a\n\n// b\n  # c\nd")),
        span=text.span(F.lit("1\r\n2\r\n3"), F.lit(2), F.lit(3)),
    )
    assert r.camel == ["http", "server", "parse", "url2json"]
    assert r.ident == ["json", "web", "token"]
    assert r.acr == "jwt"
    assert r.same == 1.0
    assert r.none == 0.0
    assert r.empty == 0.0
    assert r.parts == pytest.approx(0.5)
    assert r.fold == "a/c/d"
    assert r.pkg == "@scope/pkg"
    assert r.stem == "token"
    assert r.code == 2
    assert r.span == "2\n3"


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**", "src/a/b.ts", True), ("src/*", "src/a/b.ts", False), ("*.ts", "a.ts", True), ("a?.ts", "ab.ts", True), ("a?.ts", "a/.ts", False), ("a.ts", "a.tsx", False)])
def test_path_globs(spark, glob, path, hit):
    assert one(spark, x=F.lit(path).rlike(text.glob_regex(glob))).x == hit


@pytest.mark.parametrize(("glob", "name", "hit"), [("*", "x", True), ("a/*", "a", True), ("a/*", "a/b", True), ("a/*", "ab", False), ("a*", "ab", True), ("a", "ab", False), ("a", "a", True)])
def test_module_globs(spark, glob, name, hit):
    assert one(spark, x=text.module_matches(F.lit(glob), F.lit(name))).x == hit


@pytest.mark.parametrize(("path", "module", "lang", "test"), [("src/auth/token.ts", "auth", "ts", False), ("src/services/auth/x.ts", "services/auth", "ts", False), ("lib/payment/y.py", "payment", "py", False), ("index.ts", "(root)", "ts", False), ("src/a.go", "(root)", "go", False), ("app/src/main/java/com/x/A.java", "app/com/x", "java", False), ("src/test/kotlin/com/x/BTest.kt", "com/x", "kt", True), ("tests/test_a.py", "tests", "py", True), ("src/services/x.ts", "services", "ts", False), ("m/a.h", "m", "cpp", False)])
def test_classification(spark, path, module, lang, test):
    assert (classify.module_of(path), classify.language(path), classify.is_test(path)) == (module, lang, test)
    r = one(spark, m=classify.module_column(F.lit(path)), k=classify.language_column(F.lit(path)), t=classify.is_test_column(F.lit(path)))
    assert (r.m, r.k, r.t) == (module, lang, test)
