"""Requests and uploads: validation, routes, envelopes, entitlements, tokens. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import Settings

# Limits and codes of uploads and of JSON-RPC.
MAX_BYTES = Settings.max_pdf_bytes
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def upload_error(name: Column, content: Column, length: Column, most: int = MAX_BYTES) -> Column:
    """First failure of: empty, size, extension, magic; null if valid."""
    return F.when(content.isNull() | (length < 5), "EMPTY").when(length > most, "TOO_LARGE").when(name.isNull() | ~F.endswith(F.lower(name), F.lit(".pdf")), "NOT_PDF_NAME").when(~F.startswith(content, F.lit("%PDF-")), "NOT_PDF_CONTENT")


def route(method: Column, uri: Column) -> Column:
    """'full' (token, rate, quota), 'token' (token alone) or 'open'."""
    m = F.upper(method)
    job = F.startswith(uri, F.lit("/api/v1/audit/jobs/"))
    token = ((m == "GET") & job) | ((m == "POST") & ((uri == "/api/v1/devices/push-token") | (job & F.endswith(uri, F.lit("/cancel")))))
    return F.when((m == "POST") & uri.isin("/api/v1/audit", "/api/v1/audit/async"), "full").when(token, "token").otherwise("open")


def owned(exists: Column, owner: Column, device: Column) -> Column:
    """HTTP status of a look-up or cancel: 404 without the job, 403 for another device's, else 200; a job without owner is anyone's."""
    return F.when(~exists, 404).when(owner.isNotNull() & ~owner.eqNullSafe(device), 403).otherwise(200)


# What callers are told, by status: title and detail.
PROBLEMS = {
    400: ("Geçersiz istek", "Geçersiz istek: dosya veya istek gövdesi eksik ya da hatalı."),
    503: ("Analiz tamamlanamadı", "Analiz servisi şu anda kullanılamıyor"),
    500: ("İşlem tamamlanamadı", "Beklenmeyen bir hata oluştu"),
}


def problem(error: Column) -> Column:
    """Problem details as JSON for an error code: 400 for what the caller sent, 503 for the reviewer, 500 for all else; null without an error."""
    status = F.when(error.isin("EMPTY", "TOO_LARGE", "NOT_PDF_NAME", "NOT_PDF_CONTENT", "UNREADABLE", "MISSING_PART", "MEDIA_TYPE", "MALFORMED"), 400).when(error == "REVIEWER_UNAVAILABLE", 503).otherwise(500)
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for code, own in PROBLEMS.items() for x in (code, own[k]))), status)
    return F.when(error.isNotNull(), F.to_json(F.struct(pick(0).alias("title"), status.alias("status"), pick(1).alias("detail"))))


def jdbc(url: Column) -> Column:
    """struct(url, user, password) of a postgres address, port 5432 unless it names one; any other address as it is, without user."""
    pattern = r"^postgres(?:ql)?://(?:([^@/]*)@)?([^/:?#@]+)(?::(\d+))?([^?#]*)"
    part = lambda k: F.regexp_extract(url, pattern, k)
    own, user = url.rlike(r"^postgres(?:ql)?://"), part(1)
    port = F.when(part(3).try_cast("int") > 0, part(3)).otherwise("5432")
    full = F.concat(F.lit("jdbc:postgresql://"), part(2), F.lit(":"), port, part(4))
    colon = F.instr(user, ":")
    return F.struct(F.when(own, full).otherwise(url).alias("url"), F.when(own & (user != ""), F.when(colon > 0, F.substring(user, F.lit(1), colon - 1)).otherwise(user)).alias("user"), F.when(own & (colon > 0), F.substring(user, colon + 1, F.length(user))).alias("password"))


def decode_base64(text: Column) -> Column:
    """A data prefix and white space go, both alphabets are read, missing padding is added; null if anything else is in it."""
    bare = F.translate(F.regexp_replace(F.regexp_replace(text, r"(?i)^data:[^,]*,", ""), r"\s", ""), "-_", "+/")
    padded = F.rpad(bare, F.ceil(F.length(bare) / 4).cast("int") * 4, F.lit("="))
    return F.when((bare != "") & bare.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(F.regexp_replace(bare, "=", "")) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def jsonrpc(id_: Column, method: Column, tool: Column) -> Column:
    """The envelope of a call: a result for known methods, error -32601 for unknown ones, -32602 for an unknown tool."""
    known = method.isin("initialize", "ping", "tools/list") | ((method == "tools/call") & (tool == "audit_financial_document"))
    i = F.coalesce(id_, F.lit(""))
    error = lambda code, message: F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), i.alias("id"), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")).alias("error")))
    ok = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), i.alias("id"), F.struct(method.alias("method")).alias("result")))
    return F.when(known, ok).when(method == "tools/call", error(-32602, "Unknown tool")).otherwise(error(-32601, "Method not found"))


def entitled(json: Column, now: Column) -> Column:
    """False without the entitlement or with one that is past; true without an expiry."""
    pro = F.get_json_object(json, "$.subscriber.entitlements.pro")
    expiry = F.get_json_object(json, "$.subscriber.entitlements.pro.expires_date")
    return F.when(pro.isNull(), F.lit(False)).when(expiry.isNull(), F.lit(True)).otherwise(F.coalesce(F.try_to_timestamp(expiry) > now, F.lit(False)))


def _xored(key_hex: Column, byte: int) -> Column:
    """The key's 64 bytes, each xor the byte, as binary; hexadecimal digits are mapped by translate, as xor acts on each digit alone. Without a lambda, so that Spark works it out once where the key is a constant."""
    digits = "0123456789ABCDEF"
    high, low = byte >> 4, byte & 15
    padded = F.rpad(key_hex, 128, "0")
    mapped = [F.translate(padded, digits, "".join(digits[d ^ part] for d in range(16))) for part in (high, low)]
    return F.unhex(F.concat(*(F.substring(mapped[k % 2], k + 1, 1) for k in range(128))))


def hmac_sha256(key: Column, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a text with a key of up to 64 bytes, from sha2 alone."""
    k = F.hex(F.encode(key, "UTF-8"))
    inner = F.unhex(F.sha2(F.concat(_xored(k, 0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(_xored(k, 0x5C), inner), 256)


def base64url(binary: Column) -> Column:
    return F.rtrim(F.translate(F.base64(binary), "+/=", "-_ "))


def issue_token(device: Column, epoch: Column, secret: Column) -> Column:
    payload = F.concat_ws(":", device, epoch.cast("string"))
    return F.concat(base64url(F.encode(payload, "UTF-8")), F.lit("."), base64url(F.unhex(hmac_sha256(secret, payload))))


def verify_token(token: Column, secret: Column) -> Column:
    """The device of a valid token, else null. Tokens don't expire."""
    part = lambda k: F.get(F.split(token, r"\."), F.lit(k))
    payload = F.decode(F.coalesce(decode_base64(part(0)), F.lit(b"")), "UTF-8")
    return F.when((F.size(F.split(token, r"\.")) == 2) & (base64url(F.unhex(hmac_sha256(secret, payload))) == part(1)), F.regexp_extract(payload, "^(.*):[^:]*$", 1))
