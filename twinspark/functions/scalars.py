"""Scalar functions over names, texts and fingerprints, all as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """Identity of a text apart from white space and case; null for one that has nothing else."""
    plain = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(plain != "", F.sha2(plain, 256))


def text_file_hash(text: Column) -> Column:
    """Identity of a text file apart from a byte-order mark, line ends and trailing white space."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n"), r"(?U)\s+\z", "")
    return F.when(plain != "", F.sha2(plain, 256))


def size_bucket(size: Column) -> Column:
    """100 KiB, 10 MiB, 100 MiB, 1 GiB."""
    out = F.when(size < 100 << 10, "tiny").when(size < 10 << 20, "small").when(size < 100 << 20, "medium")
    return out.when(size < 1 << 30, "large").otherwise("huge")


def similarity(a: Column, b: Column, bits: int) -> Column:
    """Percent of equal bits of two arrays of words."""
    return (1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n) / bits) * 100


def normal_path(path: Column) -> Column:
    """Segments trimmed, empty and single-dot ones dropped, ends stripped of dots and blanks; null if any goes up."""
    parts = F.transform(F.split(path, "/"), lambda s: F.trim(s))
    kept = F.filter(parts, lambda s: (s != "") & (s != "."))
    clean = F.filter(F.transform(kept, lambda s: F.regexp_replace(s, r"[. ]+$", "")), lambda s: s != "")
    return F.when(~F.exists(parts, lambda s: s == ".."), F.nullif(F.array_join(clean, "/"), F.lit("")))


def utc_date(ms: Column) -> Column:
    """The day of a time in milliseconds, by UTC whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


def tokens() -> dict[str, Column]:
    """What a name template can hold, from a file's row."""
    best = utc_date(F.coalesce("taken_ms", "modified_ms"))
    name = F.element_at(F.split("rel_path", "/"), -1)
    safe = lambda c: F.regexp_replace(c, r"[/\\\p{Cntrl}]", "_")
    return {
        "o-path": F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1),
        "o-name": name,
        "o-stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""),
        "o-ext": F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1)),
        "year": F.date_format(best, "yyyy"),
        "month": F.date_format(best, "MM"),
        "day": F.date_format(best, "dd"),
        "mime": safe(F.col("mime")),
        "mimetop": F.split("mime", "/")[0],
        "camera": safe(F.col("camera")),
        "origin": safe(F.col("origin")),
        "size": size_bucket(F.col("size")),
        "w": F.col("img_w").cast("string"),
        "h": F.col("img_h").cast("string"),
    }


def rendered(template: str) -> Column:
    """A template with {token|other|"text"}: the first that is not empty; unknown tokens are empty."""
    known, parts, at = tokens(), [], 0
    for m in re.finditer(r"\{([^{}]*)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        options = [x.strip() for x in m[1].split("|")]
        values = [F.lit(x[1:-1]) if len(x) > 1 and x[0] == x[-1] == '"' else F.nullif(known[x], F.lit("")) if x in known else F.lit(None).cast("string") for x in options]
        parts.append(F.coalesce(*values, F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def printable_runs(text: Column, least: int = 4, most: int | None = 100) -> Column:
    """Runs of at least `least` printable ASCII characters: the first `most` as an excerpt, or with None all."""
    runs = F.regexp_extract_all(text, F.lit(f"[ -~]{{{least},}}"), F.lit(0))
    return runs if most is None else F.slice(runs, 1, most)


#: Words that mark a file's name, and headers that mark a private key.
FINANCIAL = ("steuer", "steuererklärung", "steuererklaerung", "tax", "invoice", "rechnung", "kontoauszug", "iban", "versicherung", "insurance")
IDENTITY = ("testament", "vollmacht", "passport", "reisepass", "ausweis", "urkunde", "geburtsurkunde")
KEY_HEADERS = ("BEGIN OPENSSH PRIVATE KEY", "BEGIN RSA PRIVATE KEY", "BEGIN EC PRIVATE KEY", "BEGIN DSA PRIVATE KEY", "BEGIN PGP PRIVATE KEY")
PROBE_BYTES, SEED_BYTES, JSON_BYTES = 1 << 20, 16 << 10, 256 << 10


def flagged(path: Column, mime: Column, size: Column, content: Column, seed_words: tuple[str, ...] = ()) -> Column:
    """{category, reason} of a file that should not lie about: Wallet, Vault, Key, Financial or Identity; else null.

    Rules by name come first; contents of small files other than media are probed after them.
    `seed_words` are the words of a wallet's recovery phrase, of which twelve in a row make one.
    """
    lower = F.lower(F.regexp_replace(path, r"\\", "/"))
    name = F.element_at(F.split(lower, "/"), -1)
    stem = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^\p{L}\p{N}]")
    marked = lambda words: F.arrays_overlap(stem, F.array(*[F.lit(w) for w in words]))
    in_ssh = name.isin("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519") | lower.rlike(r"(^|/)\.ssh/")
    small = (size <= PROBE_BYTES) & ~F.coalesce(mime.rlike("^(image|video|audio)/"), F.lit(False))
    headed = lambda h: content.contains(h) & (F.octet_length(F.substring_index(content, h, 1)) + len(h) <= 200)
    store = content.contains('"cipher"') & content.contains('"kdfparams"') & (content.contains('"crypto"') | content.contains('"Crypto"'))
    electrum = content.contains('"seed_version"') | (content.contains('"wallet_type"') & content.contains('"keystore"'))
    magic = F.hex(F.substring(F.encode(content, "utf-8"), 13, 4)).isin("00053162", "62310500")  # either byte order
    #: The reasons, in the order of the rules.
    rules = [
        (name == "wallet.dat", "Wallet", "filename matches wallet.dat"),
        (name.endswith(".wallet"), "Wallet", "wallet file extension"),
        (name.rlike(r"\.(kdbx|kdb)$"), "Vault", "KeePass database"),
        (name.endswith(".1pif"), "Vault", "1Password export"),
        (lower.rlike(r"(^|/)\.gnupg/"), "Key", "GnuPG keyring path"),
        (in_ssh & ~name.endswith(".pub"), "Key", "SSH key material"),
        *[(name.endswith(x), "Key", f"key/cert file ({x})") for x in (".pem", ".p12", ".pfx", ".gpg")],
        (name.endswith(".key") & ~F.coalesce(mime == "application/zip", F.lit(False)), "Key", "key/cert file (.key)"),
        (marked(FINANCIAL), "Financial", "financial-document filename keyword"),
        (marked(IDENTITY), "Identity", "vital-record filename keyword"),
        (small & magic, "Wallet", "Berkeley DB (wallet.dat family)"),
        *[(small & headed(h), "Key", f"private key header ({h})") for h in KEY_HEADERS],
        (small & (size <= JSON_BYTES) & store, "Wallet", "Ethereum keystore JSON (crypto/cipher/kdfparams)"),
        (small & (size <= JSON_BYTES) & electrum, "Wallet", "Electrum wallet JSON"),
    ]
    if seed_words:
        known = F.array(*[F.lit(w) for w in seed_words])
        words = F.filter(F.split(F.lower(content), "[^a-z]+"), lambda w: w != "")
        count = lambda s, w: F.when(F.array_contains(known, w), s["now"] + 1).otherwise(0)
        run = F.aggregate(words, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, w: F.struct(count(s, w).alias("now"), F.greatest(s["most"], count(s, w)).alias("most")))
        rules.append((small & (size <= SEED_BYTES) & (run["most"] >= 12), "Wallet", "contains a BIP-39 seed phrase (12+ wordlist words)"))
    flag = lambda category, reason: F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))
    out = F.when(rules[0][0], flag(*rules[0][1:]))
    for condition, category, reason in rules[1:]:
        out = out.when(condition, flag(category, reason))
    return out


def sensitive(path: Column, mime: Column, size: Column, content: Column, seed_words: tuple[str, ...] = ()) -> Column:
    """The category of flagged()."""
    return flagged(path, mime, size, content, seed_words)["category"]


def human_size(size: Column) -> Column:
    """Bytes with two decimals, halves to even, of the largest unit of 1024 that they reach."""
    out = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((2, "KB"), (3, "MB"), (4, "GB")):
        out = out.when(size < 1 << 10 * power, F.format_string(f"%.2f {unit}", F.bround(size / (1 << 10 * (power - 1)), 2)))
    return out.otherwise(F.format_string("%.2f TB", F.bround(size / (1 << 40), 2)))


def age_in_words(ms: Column, now_ms: Column) -> Column:
    """How long ago a scan was; 0 is never, and what lies ahead is now."""
    seconds = F.floor(F.greatest(now_ms - ms, F.lit(0)) / 1000)
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    out = F.when(ms == 0, "never").when(seconds < 60, "just now").when(seconds < 3600, some(F.floor(seconds / 60), "minute"))
    return out.when(seconds < 86400, some(F.floor(seconds / 3600), "hour")).otherwise(some(F.floor(seconds / 86400), "day"))


def stays_within(path: Column) -> Column:
    """Whether a relative path cannot leave its root: not absolute, and no step up."""
    return ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda s: s == "..")


def member_path(name: Column) -> Column:
    """An archive member's name as a path below the target: ordinary parts only; null if none is left."""
    parts = F.filter(F.split(F.regexp_replace(name, r"\\", "/"), "/"), lambda s: ~s.isin("", ".", ".."))
    return F.nullif(F.array_join(parts, "/"), F.lit(""))


def is_playlist(mime: Column) -> Column:
    return F.coalesce(mime.isin("audio/x-mpegurl", "audio/mpegurl", "application/x-mpegurl", "application/vnd.apple.mpegurl", "audio/x-scpls"), F.lit(False))


def is_audio(mime: Column) -> Column:
    return F.coalesce(mime.startswith("audio/"), F.lit(False)) & ~is_playlist(mime)


#: MIME types of office documents, magic numbers and name endings.
OFFICE = (
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.oasis.opendocument.presentation",
    "application/vnd.ms-excel",
)
MAGIC = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("494433", "audio/mpeg"), ("664C6143", "audio/x-flac"), ("4F676753", "audio/ogg"))
ENDINGS = (("txt", "text/plain"), ("md", "text/markdown"), ("csv", "text/csv"), ("eml", "message/rfc822"), ("html", "text/html"), ("json", "application/json"), ("pdf", "application/pdf"), ("png", "image/png"), ("jpg", "image/jpeg"), ("m4a", "audio/m4a"), ("m4b", "audio/m4b"), ("mp3", "audio/mpeg"), ("mp4", "video/mp4"))


def is_office(mime: Column) -> Column:
    return F.coalesce(mime.isin(*OFFICE), F.lit(False))


def is_extractable(mime: Column) -> Column:
    """Whether text can be taken out of it."""
    return is_office(mime) | F.coalesce(mime.isin("application/pdf", "message/rfc822"), F.lit(False))


def detected_mime(path: Column, content: Column) -> Column:
    """MIME type by magic number, then by the name's ending; an MP4 container that is named as audio is audio."""
    head = F.hex(F.substring(content.cast("binary"), 1, 16))
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    named = F.lit(None).cast("string")
    for end, mime in ENDINGS:
        named = F.when(ending == end, mime).otherwise(named)
    out = F.when(F.substring(head, 9, 8) == "66747970", F.when(named.startswith("audio/"), named).otherwise("video/mp4"))
    for magic, mime in MAGIC:
        out = out.when(head.startswith(magic), mime)
    return out.otherwise(named)


def email_identity(message: Column) -> Column:
    """Identity of a mail: its Message-ID, or else its subject and body; null if it has neither."""
    parts = F.split(F.regexp_replace(message, "\r\n?", "\n"), "\n\n", 2)
    header = F.regexp_replace(parts[0], "\n[ \t]+", " ")
    field = lambda name: F.nullif(F.trim(F.regexp_extract(header, rf"(?im)^{name}:(.*)$", 1)), F.lit(""))
    number = F.regexp_replace(field("message-id"), "^<|>$", "")
    body = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return text_hash(F.coalesce(F.concat(F.lit("message-id:"), number), F.concat(F.coalesce(field("subject"), F.lit("")), F.lit("\n"), body)))


def words_seed(words: Column) -> Column:
    """Digest of an array of print words; null for none."""
    return F.when(F.size(words) > 0, F.sha2(F.array_join(F.transform(words, lambda w: w.cast("string")), ","), 256))
