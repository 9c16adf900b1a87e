"""Container build and orchestration files to provider, package and key evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, case, let, present
from ..functions.packages import capability, resolve_package, with_library
from ..functions.text import strip
from ..session import write_stage
from ..sources.schemas import DETECTOR_RANK, conform
from .facts import fact, facts_of, found, together

COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
# Instruction patterns.
FROM = r"(?imd)^\s*FROM\s+(?:--platform=\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?"
OS_INSTALL = (r"(?i)(?:apt-get|apt|apk|yum|dnf|microdnf|zypper)\s+(?:--\S+\s+)*(?:add|install)\s+"
              r"((?:[^\n&|;]|\\\n)+)")
PIP_INSTALL = r"(?i)pip3?\s+install\s+((?:[^\n&|;]|\\\n)+)"
NPM_INSTALL = r"(?i)npm\s+(?:install|i|ci)\s+((?:[^\n&|;]|\\\n)+)"
COPY_KEYS = (r"(?imd)^\s*(?:COPY|ADD)\s+(\S*(?:\.crt|\.pem|\.key|\.p12|\.pfx|\.jks|certs?/|ssl/)\S*)\s+(\S+)")
ENV_TLS = r"(?imd)^\s*(?:ENV|ARG)\s+([A-Z_]*(?:TLS|SSL|CIPHER|CERT|CRYPTO)[A-Z_]*)[= ]\s*(\S+)"
IMAGE = r"(?md)^\s*(?:-\s*)?image:\s*['\"]?([^\s'\"#]+)"
NAME = r"(?md)^\s*(?:name|container_name|serviceName):\s*['\"]?([^\s'\"#]+)"
TLS_KEYS = (r"(?imd)^\s*(tls|secretName|caBundle|sslMode|tlsMinVersion|cipherSuites?|clientAuth)"
            r"\s*:\s*['\"]?([^\n#]*)")
# Fixed values, in order: substring of the image -> provider it implies.
BASE_IMAGES = [
    ("alpine", "libssl"), ("debian", "libssl"), ("ubuntu", "libssl"), ("openjdk", "jca"),
    ("eclipse-temurin", "jca"), ("amazoncorretto", "jca"), ("python", "python-cryptography"),
    ("node", "node-crypto"), ("golang", "go-crypto"), ("nginx", "openssl"), ("httpd", "openssl"),
    ("postgres", "openssl"), ("redis", "openssl"), ("haproxy", "openssl"),
    ("envoyproxy", "boringssl"), ("distroless", "openssl"),
]


def is_dockerfile(path: Column) -> Column:
    base = F.lower(basename(path))
    return (base == "containerfile") | base.startswith("dockerfile")


def is_orchestration(path: Column) -> Column:
    base = F.lower(basename(path))
    return base.isin(*COMPOSE) | ((base.endswith(".yaml") | base.endswith(".yml")) & F.contains(F.lower(path), F.lit("k8s")))


def base_provider(image: Column) -> Column:
    low = F.lower(image)
    return case(*[(F.contains(low, F.lit(k)), v) for k, v in BASE_IMAGES])


def image_tag(image: Column) -> Column:
    last = F.element_at(F.split(image, "/"), -1)
    return F.when(F.contains(last, F.lit(":")), F.element_at(F.split(last, ":"), -1)).otherwise("latest")


def split_packages(blob: Column) -> Column:
    parts = F.split(strip(F.replace(blob, F.lit("\\\n"), F.lit(" "))), r"\s+")
    kept = F.filter(parts, lambda p: (p != "") & ~p.startswith("-") & ~p.isin("&&", "\\", "|", ";"))
    return F.transform(kept, lambda p: F.regexp_replace(p, r"^['\"`,]+|['\"`,]+$", ""))


def os_version(pkg: Column) -> tuple[Column, Column]:
    name = F.substring_index(pkg, "=", 1)
    version = F.when(F.contains(pkg, F.lit("=")), F.regexp_replace(pkg, r"^[^=]*=", ""))
    return name, version


def language_version(pkg: Column) -> tuple[Column, Column]:
    """First separator of a fixed list that occurs, then split at its first place."""
    seps = ("==", "@", ">=", "~=")
    name = case(*[(F.contains(pkg, F.lit(s)), F.substring_index(pkg, s, 1)) for s in seps], otherwise=pkg)
    version = case(*[(F.contains(pkg, F.lit(s)), F.regexp_extract(pkg, r"(?s)^.*?" + s.replace("~", "\\~") + "(.*)$", 1)) for s in seps])
    return name, version


def docker_facts(text: Column) -> Column:
    """Facts of a build file: image, os-package, lang-package, key-file and setting."""
    path = F.col("path")
    folder = F.when(F.size(F.split(path, "/")) > 1, F.try_element_at(F.split(path, "/"), F.lit(-2)))
    container = F.coalesce(F.when(folder != "", folder), basename(path))
    pos = lambda m, rank: F.lit(rank * 10**9).cast("bigint") + m["pos"] * 10**4

    def facts(pattern, kind, rank, **groups):
        names = list(groups)
        return found(text, pattern, lambda m: fact(kind, pos=pos(m, rank), a=m[names[0]], b=m[names[1]] if len(names) > 1 else None, c=container), **groups)

    def packages(pattern, kind, rank, versioned, keep=None):
        def row(m):
            each = F.transform(split_packages(m["blob"]), lambda pkg, k: fact(kind, pos=pos(m, rank) + k, a=versioned(pkg)[0], b=versioned(pkg)[1], c=container))
            return F.filter(each, keep) if keep else each

        return F.flatten(found(text, pattern, row, blob=1))

    named = lambda f: (f["a"] != "") & ~f["a"].startswith(".") & ~f["a"].startswith("/") & ~f["a"].startswith("-")
    return F.when(is_dockerfile(path), together(
        facts(FROM, "image", 0, image=1), packages(OS_INSTALL, "os-package", 1, os_version),
        packages(PIP_INSTALL, "lang-package", 2, language_version, named), packages(NPM_INSTALL, "lang-package", 3, language_version, named),
        facts(COPY_KEYS, "key-file", 4, ref=1), facts(ENV_TLS, "setting", 5, key=1, value=2)))


def orchestration_facts(text: Column) -> Column:
    """Images of a compose or cluster file; its settings belong to the first of them."""
    path = F.col("path")
    images, names = (F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in (IMAGE, NAME))
    container = lambda z: F.coalesce(z["name"], F.substring_index(F.element_at(F.split(z["image"], "/"), -1), ":", 1))

    def of_pairs(pairs):
        each = F.transform(pairs, lambda z, i: F.when(z["image"].isNotNull(), fact("image", pos=i.cast("bigint") * 10**10, a=z["image"], c=container(z))))
        first = F.get(pairs, F.lit(0))
        settings = found(text, TLS_KEYS, lambda m: fact("setting", pos=F.lit(5 * 10**9).cast("bigint") + m["pos"] * 10**4, a=m["key"], b=strip(m["value"]), c=container(first)), key=1, value=2)
        return together(F.array_compact(each), F.when(first["image"].isNotNull(), settings))

    zipped = let(images, lambda i: F.arrays_zip(i.alias("image"), F.slice(names, 1, F.greatest(F.size(i), F.lit(1))).alias("name")))
    return F.when(is_orchestration(path) & ~is_dockerfile(path), let(zipped, of_pairs))


def container_facts(text: Column) -> Column:
    return together(docker_facts(text), orchestration_facts(text))


def container_detections(files: DataFrame) -> DataFrame:
    """Detections of build and orchestration files. Their facts are stored, as five kinds of
    detection read them; other files are left out before their texts are looked at."""
    path = F.col("path")
    return refine(write_stage(facts_of(files.where(is_dockerfile(path) | is_orchestration(path)), container_facts), "container-facts"))


def refine(facts: DataFrame) -> DataFrame:
    kinds = ("image", "os-package", "lang-package", "key-file", "setting")
    f = facts.where(F.col("fact").isin(*kinds)).select("path", F.col("c").alias("container"), F.col("fact").alias("kind"), F.col("pos").alias("ord"), "a", "b")
    common = {"file": F.col("path"), "detector": F.lit("container"), "language": F.lit("container"),
              "det_rank": F.lit(DETECTOR_RANK["container"]), "sub": F.lit(0)}
    image = with_library(f.where("kind = 'image'").withColumn("library", base_provider(F.col("a"))).where("library IS NOT NULL"))
    tag = image_tag(F.col("a"))
    cap = capability(F.col("lib_pqc"), F.col("lib_since"), F.lit(None).cast("string"))
    floating = tag.isin("latest", "")
    bases = image.withColumns({**common, "method": F.lit("base-image"), "confidence": F.lit("medium"),
                               "matched": F.col("a"), "image": F.col("a"), "floating_tag": floating,
                               "pqc_capability": cap, "pqc_note": F.concat_ws(" ", "library", F.lit("capability"), cap),
                               "api_call": F.lit("container-base-image"), "reasoning": F.lit("base image implies a provider")})
    loose = image.where(floating).drop("library").withColumns({
        **common, "ord": F.col("ord") + 1, "method": F.lit("base-image"), "confidence": F.lit("high"),
        "matched": F.col("a"), "image": F.col("a"), "crypto_agility_blocker": F.lit(True),
        "api_call": F.lit("container-floating-tag"), "reasoning": F.lit("floating tag is not reproducible")})
    pkg = with_library(f.where("kind IN ('os-package', 'lang-package')")
                       .withColumn("library", resolve_package(F.col("a"))).where("library IS NOT NULL"))
    pcap = capability(F.col("lib_pqc"), F.col("lib_since"), F.col("b"))
    pkgs = pkg.withColumns({**common, "method": F.col("kind"), "confidence": F.lit("high"), "library_version": F.col("b"),
                            "package": F.col("a"), "matched": F.concat_ws("=", "a", F.when(present(F.col("b")), F.col("b"))),
                            "pqc_capability": pcap, "pqc_note": F.concat_ws(" ", "lib_name", "b", F.lit("capability"), pcap),
                            "api_call": F.concat(F.lit("container-"), "kind"), "reasoning": F.lit("package installed in the image")})
    is_key = F.col("a").rlike(r"(?i)\.(key|p12|pfx|jks)$")
    keys = f.where("kind = 'key-file'").withColumns({
        **common, "method": F.lit("image-file"), "confidence": F.lit("high"), "matched": F.col("a"),
        "key_material_in_image": is_key, "api_call": F.lit("container-pki-file"),
        "reasoning": F.when(is_key, "key material baked into the image").otherwise("certificate shipped in the image")})
    env = f.where("kind = 'setting'").withColumns({
        **common, "method": F.lit("env-config"), "confidence": F.lit("medium"), "matched": F.concat_ws("=", "a", "b"),
        "api_call": F.lit("container-env"), "reasoning": F.lit("crypto-relevant setting")})
    return reduce(DataFrame.unionByName, [conform(x) for x in (bases, loose, pkgs, keys, env)])
