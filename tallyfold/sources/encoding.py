"""Encodings of text files: UTF-8 with or without its mark, or Windows-1253. Nothing is guessed."""

from __future__ import annotations

from tallyfold.errors import EncodingDetectionError

GREEK_LEAST = 7


def greek_letters(text: str) -> int:
    return sum("Ά" <= c <= "ώ" for c in text)


def detect(name: str, data: bytes) -> tuple[str, str]:
    """(encoding, text)."""
    marked = data.startswith(b"\xef\xbb\xbf")
    try:
        return ("utf-8-bom", data[3:].decode("utf-8")) if marked else ("utf-8", data.decode("utf-8"))
    except UnicodeDecodeError as e:
        if marked:
            raise EncodingDetectionError(f"{name}: invalid UTF-8 after its byte order mark") from e
    try:
        text = data.decode("cp1253")
    except UnicodeDecodeError as e:
        raise EncodingDetectionError(f"{name}: neither UTF-8 nor Windows-1253") from e
    if greek_letters(text) < GREEK_LEAST:
        raise EncodingDetectionError(f"{name}: not UTF-8, and too little Greek for Windows-1253; refusing to guess")
    return "cp1253", text


def encode_cp1253(text: str) -> bytes:
    return text.encode("cp1253")
