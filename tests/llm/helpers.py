"""Small frames and brute-force versions for the tests of this folder."""

import re

WORD = re.compile(r"[^\x20\t-\r]+")


def documents(spark, texts, first=0):
    """Documents with ids from ``first`` on, all columns of the table present."""
    rows = [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def shingle_set(text, size=5):
    words = WORD.findall(text or "")
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def unigram_model(path):
    """The bytes of a SentencePiece model with its segmentation rule set to unigram."""

    def varint(data, at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(data):
        at = 0
        while at < len(data):
            start = at
            tag, at = varint(data, at)
            body = at
            if tag & 7 == 0:
                _, at = varint(data, at)
            elif tag & 7 == 2:
                size, body = varint(data, at)
                at = body + size
            else:
                at += {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[start:at], data[body:at]

    def number(value):
        out = b""
        while value > 127:
            out += bytes([value & 127 | 128])
            value >>= 7
        return out + bytes([value])

    with open(path, "rb") as file:
        model = file.read()
    out = b""
    for field, whole, body in fields(model):
        if field == 2:  # the trainer's settings, whose field 3 is the rule: 1 is unigram
            body = b"".join(b"\x18\x01" if f == 3 else w for f, w, _ in fields(body))
            whole = b"\x12" + number(len(body)) + body
        out += whole
    return out
