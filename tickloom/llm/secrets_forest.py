"""Secret scans: patterns propose candidates, and a random forest takes out the false ones.

Candidates are all words of eight characters or more that mix letters and digits, known prefixes, and what is assigned to names such as
token or password: addresses, dates, hashes and codes among them, which the forest has to tell from keys. A word without blanks may hold many: each known key, and each key=value or key:value part of a query string, a
line of JSON, CSV or configuration, is tested for itself. The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, path
signs, and the neighbouring words. It is trained from labelled findings: (text, start, end, is_secret), by default a fixed set that
`labelled_findings` generates by rule from a seed.

Null and empty texts have no candidates, and an empty table gives an empty result. Whole texts are read, of any length. Repeated rows and
repeated candidates each count; a score at the threshold is a secret. Spans are in code points, end exclusive. Columns besides id and
text are not read.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import slices, utf8
from tickloom.llm.forest import Forest
from tickloom.llm.textvec import word_spans

#: Words of ordinary prose and code that a random key does not spell.
DICTIONARY = tuple("the and for are with that this from have not you all can was one our out day get has him his how man new now old see two way who boy did its let put say she too use that will your about there could other which their what when make like time just know take people into year good some them than then look only come over think also back after work first well even want because these give most data user name file path test example sample value index config build main master version release commit hash node page image icon font style color table field class object method function return string number array list type default public private local server client host port http https www com org net html json xml yaml docs source lib bin usr home etc var tmp src app dist module package import export".split())
_CUES = re.compile(r"secret|token|passw|pwd|api.?key|access.?key|auth|credential|private|bearer|login", re.I)
_DULL = re.compile(r"commit|sha\d*|md5|hash|checksum|digest|uuid|guid|id\b|example|sample|test|dummy|version|revision|etag|integrity|nonce|page|image|path", re.I)
_KNOWN = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
#: What a word holds that may be a known key: the quick look searches bytes.
_PREFIX = re.compile(rb"AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk_live_|eyJ")
_EDGE = "\"'`,;()[]{}<>"
#: Between the parts of a word; what assigns; what ends a key on its left; what ends an unquoted value: a quote, a brace, or the next key.
_PART = re.compile(r"[&,;\"'`{}]")
_PART_OF_ONE = re.compile(r"[,;\"'`{}]")  # of a word that is neither a query nor holds pairs joined by &
_PAIRED = re.compile(r"\?|&[\"']?[\w.\[\]-]+[\"']?[:=]")
_MARK = re.compile(r"[:=]+>?")
_KEY_CUT = re.compile(r"[\"'`&,;{}?=:<>\s]")
_NEXT = re.compile(r"[\"'`{}]|[&,;](?=[\"']?[\w.\[\]-]+[\"']?[:=])")
_NAME_END = re.compile(r"[\"'`]\]?[:=]")
_REACH = 48


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str) -> list[float]:
    """What the forest sees of a candidate and its neighbourhood. The time is linear in the candidate's length."""
    n = max(1, len(value))
    kinds = [_kind(c) for c in value]
    moves = [sum(a == x and b == y for a, b in zip(kinds, kinds[1:], strict=False)) / n for x, y in ((0, 0), (0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1), (2, 2), (1, 1))]
    low = value.lower()
    covered = np.zeros(n, bool)
    for w in DICTIONARY:
        at = low.find(w) if len(w) > 2 else -1
        while at >= 0:
            covered[at : at + len(w)] = True
            at = low.find(w, at + 1)
    shares = np.array([value.count(c) for c in set(value)]) / n
    vowels = sum(c in "aeiou" for c in low) / max(1, sum(c.isalpha() for c in low))
    return [
        n, -float((shares * np.log2(shares)).sum()), *moves, float(covered.mean()), vowels,
        sum(c in "0123456789abcdef" for c in low) / n, float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        value.count("/") / n, value.count(".") / n, value.count("-") / n, value.count("_") / n, float("://" in value or value.startswith(("/", "./", "~"))),
        float(bool(_KNOWN.search(value))), float(bool(_CUES.search(before))), float(bool(_DULL.search(before))), float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(bool(_DULL.search(after))),
        value.count("@") / n, value.count(":") / n, float(value[0].isdigit()), float(bool(re.fullmatch(r"[^\W\d_]+[0-9]{1,4}|[0-9]{1,4}[^\W\d_]+", value))), len(set(value)) / n, float(max((len(m[0]) for m in re.finditer(r"(.)\1*", value, re.S)), default=0)),
    ]


def _key(text: str, lo: int, mark: int, cuts: list[int]) -> str:
    """The name just before a mark of assignment, from its true start. cuts: ends of what separates names in the word that starts at lo."""
    while mark > lo and text[mark - 1] in "\"'`])":
        mark -= 1
    k = bisect_right(cuts, mark)
    return text[cuts[k - 1] if k else lo : mark]


def _named_before(text: str, a: int) -> bool:
    """Whether one of the three words before a names a secret, and the last of them ends in a mark of assignment."""
    at = a
    while at > 0 and text[at - 1] in " \t\n\r\x0b\x0c\"'":
        at -= 1
    if not at or text[at - 1] not in ":=":
        return False
    for _ in range(3):
        end = at
        while at > 0 and text[at - 1] not in " \t\n\r\x0b\x0c":
            at -= 1
        if _CUES.search(text, at, end):
            return True
        while at > 0 and text[at - 1] in " \t\n\r\x0b\x0c":
            at -= 1
    return False


def _end(text: str, lo: int, b: int) -> int:
    """Where the assigned value that starts at lo ends: at its closing quote, or else where the next part starts."""
    if lo > 0 and text[lo - 1] in "\"'`":
        hi = text.find(text[lo - 1], lo, b)
        return b if hi < 0 else hi
    m = _NEXT.search(text, lo, b)
    return m.start() if m else b


def candidates(text: str, spans) -> list[tuple[int, int]]:
    """Spans of candidates among the words (spans in code points) that the quick look took out."""
    out = []
    for a, b in spans:
        found = [m.span() for m in _KNOWN.finditer(text, a, b)]
        taken = bytearray(b - a)
        for lo, hi in found:
            taken[lo - a : hi - a] = b"\1" * (hi - lo)

        def propose(lo, hi, assigned, a=a, taken=taken, found=found):
            while lo < hi and text[lo] in _EDGE:
                lo += 1
            while hi > lo and text[hi - 1] in _EDGE + ".":
                hi -= 1
            if hi - lo < (6 if assigned else 8) or 1 in taken[lo - a : hi - a]:
                return
            value = text[lo:hi]
            mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            if assigned or mixed and re.fullmatch(r"[A-Za-z0-9+/=_.@:%~&-]+", value):
                found.append((lo, hi))
                taken[lo - a : hi - a] = b"\1" * (hi - lo)

        lo = a
        while lo < b and text[lo] in _EDGE:
            lo += 1
        past = a  # the end of the last assigned value: marks in it assign nothing
        if _named_before(text, a):
            past = _end(text, lo, b)
            propose(lo, past, True)
        cuts = [m.end() for m in _KEY_CUT.finditer(text, a, b)]
        parts = [a, *(m.end() for m in (_PART if _PAIRED.search(text, a, b) else _PART_OF_ONE).finditer(text, a, b)), b + 1]
        for p, q in zip(parts, parts[1:], strict=False):
            part = text[p : q - 1]
            # a part without inner quotes or separators is named by all that stands before its last mark, as in token[0]=x
            cut = max(part.rstrip("=").rfind("="), part.rfind(":") if "://" not in part else -1)
            marks = [m for m in _MARK.finditer(text, max(p, past), q - 1)] if max(p, past) < q - 1 else []
            named = False
            for m in marks:
                if m.start() < past or text[m.start() : m.start() + 3] == "://":
                    continue
                if _CUES.search(_key(text, a, m.start(), cuts)):
                    lo = m.end()
                    while lo < b and text[lo] in _EDGE and text[lo] not in ",;":
                        lo += 1
                    past = _end(text, lo, b)
                    propose(lo, past, True)
                    named = True
            if named or p < past:
                continue
            if cut >= 0 and _CUES.search(part[:cut]):
                propose(p + cut + 1, q - 1, True)
            elif cut >= 0 and ":" in part:
                propose(p + cut + 1, q - 1, False)
            if not _NAME_END.match(text, q - 1, b):  # the name of what is assigned is no value
                propose(p, q - 1, False)
        out += sorted(found)
    return out


def labelled_findings(seed: int = 11, n: int = 1600) -> list[tuple[str, int, int, int]]:
    """Labelled findings by rule: keys of many makes in their usual places, and look-alikes (hashes, ids, paths, placeholders, long words)."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    word = lambda: rng.choice(DICTIONARY)
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    secret = [
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)), lambda: ("key ", "ghp_" + pick(alnum, 36)),
        lambda: (rng.choice(["token = \"", "token=", "secret: ", "api_key = '", "auth_token: "]), pick(hexa, rng.choice([32, 40, 64]))),
        lambda: (rng.choice(["password=", "passwd: ", "pwd = ", "password: \""]), pick(rng.choice([alnum, hexa]), rng.randint(8, 24))),
        lambda: (rng.choice(["access_key=", "secret_key = \"", "Bearer ", "private_key: "]), pick(alnum + "+/", rng.randint(24, 60))),
        lambda: ("", "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24)), lambda: ("credential ", pick(alnum, rng.randint(24, 40))),
        lambda: (rng.choice(["", "key: ", "use "]), rng.choice([word()[:3], pick(string.ascii_uppercase, 2)]) + rng.choice("_.-") + pick(alnum, rng.randint(20, 40)) + rng.choice(["", "." + pick(alnum, 27)])),
        lambda: (rng.choice(["Bearer ", "auth: ", ""]), pick(alnum + "-_", rng.randint(32, 64))),
    ]
    other = [
        lambda: (rng.choice(["commit ", "sha1 ", "md5: ", "checksum = ", "etag: \"", "digest "]), pick(hexa, rng.choice([32, 40, 64]))),
        lambda: (rng.choice(["", "uuid ", "id: "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))), lambda: ("see ", "/" + "/".join(word() + (pick(string.digits, 2) if rng.random() < 0.4 else "") for _ in range(rng.randint(3, 7)))),
        lambda: ("at ", "https://" + ".".join([word(), word(), "com"]) + "/" + pick(string.digits, 5) + "/" + word()), lambda: (rng.choice(["token=", "password=", "api_key: "]), rng.choice(["your_", "example_", "my-", "test_"]) + "_".join(word() for _ in range(3))),
        lambda: ("password: ", rng.choice("xX*0") * rng.randint(8, 24)), lambda: ("", "_".join(word() for _ in range(4)) + pick(string.digits, 3)), lambda: ("image ", "iVBORw0KGgo" + pick(alnum + "+/", rng.randint(60, 160))),
        lambda: ("version ", ".".join(pick(string.digits, 3) for _ in range(5)) + "-rc1-" + word() + word()), lambda: ("page ", word() + "-" + word() + "-" + pick(string.digits, 8) + ".html"),
        lambda: ("token ", word() + word() + word() + pick(string.digits, 2)), lambda: (rng.choice(["", "mail ", "write to "]), word() + "." + pick(string.digits, 2) + "@" + word() + pick(string.digits, 1) + ".example.com"),
        lambda: ("", rng.choice([word() + pick(string.digits, rng.randint(1, 4)) + word(), pick(string.digits, 2) + word() + word()]).ljust(8, "s")), lambda: ("order ", pick(string.ascii_uppercase, 3) + "-" + pick(string.digits, 6)),
        lambda: ("on ", "20" + pick(string.digits, 2) + "-0" + pick(string.digits, 1) + "-1" + pick(string.digits, 1) + "T0" + pick(string.digits, 1) + ":3" + pick(string.digits, 1) + "Z"), lambda: ("", word() + "_" + word() + pick(string.digits, 2) + rng.choice([".png", ".csv", ".py"])),
        lambda: ("", "www." + word() + pick(string.digits, 2) + ".com/" + word()),
    ]
    out = []
    for k in range(n):
        label = k % 2
        cue, value = rng.choice(secret if label else other)()
        lead = " ".join(word() for _ in range(rng.randint(0, 5)))
        packed = not cue and rng.random() < 0.4  # as a value in a line of JSON or CSV
        head = (lead + " " if lead else "") + (rng.choice(['{"' + word() + '":"', word() + ",", '{"a":"', '","' + word() + '":"']) if packed else cue)
        out.append((head + value + rng.choice(["\"}", ",", "\",\""] if packed else ["", "\"", " "]) + " " + word(), len(head), len(head) + len(value), label))
    return out


def train(findings=None) -> Forest:
    """The forest from labelled findings (text, start, end, 1 for a secret)."""
    findings = labelled_findings() if findings is None else findings
    x = np.array([features(t[a:b], t[max(0, a - _REACH) : a], t[b : b + _REACH]) for t, a, b, _ in findings])
    return Forest().fit(x, np.array([f[3] for f in findings]))


def _looked_out(data: np.ndarray, at: np.ndarray):
    """Words (in bytes) worth a look: of eight bytes or more with a digit, with = or : in them or just before, or with the beginning of a known key."""
    starts, ends, first = word_spans(data, at)
    if not len(starts):
        return []
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    marks = np.concatenate([[0], np.cumsum((data == 61) | (data == 58))])
    mark = marks[ends] > marks[starts]
    take = (ends - starts >= 8) & (digits[ends] > digits[starts]) | mark
    after = np.zeros(len(take), bool)
    after[1:] = (data[ends[:-1] - 1] == 61) | (data[ends[:-1] - 1] == 58)
    hits = np.array([m.start() for m in _PREFIX.finditer(data.tobytes())], np.int64)
    known = np.searchsorted(starts, hits, "right") - 1
    take[known[known >= 0]] = True
    chosen = np.flatnonzero(take | after)
    rows = np.searchsorted(first, chosen, "right") - 1
    return list(zip(rows.tolist(), starts[chosen].tolist(), ends[chosen].tolist(), strict=True))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """id, n_candidates and findings (array of start, end, value, score, is_secret) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    forest = forest or train()
    found_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("value", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())]))

    def work(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                data, at = utf8(batch.column(1))
                texts: dict[int, str] = {}
                per: dict[int, list] = {}
                for row, a, b in _looked_out(data, at):
                    base = int(at[row])
                    if row not in texts:
                        texts[row] = data[base : int(at[row + 1])].tobytes().decode()
                        per[row] = []
                    last = per[row][-1] if per[row] else (0, 0, 0)
                    lo = last[1] + len(data[base + last[2] : a].tobytes().decode())
                    hi = lo + len(data[a:b].tobytes().decode())
                    per[row].append((lo, hi, b - base))
                spans = [(row, a, b) for row in per for a, b in candidates(texts[row], [p[:2] for p in per[row]])]
                x = np.array([features(texts[r][a:b], texts[r][max(0, a - _REACH) : a], texts[r][b : b + _REACH]) for r, a, b in spans])
                scores = forest.predict(x) if len(spans) else []
                out: list[list] = [[] for _ in range(batch.num_rows)]
                for (r, a, b), s in zip(spans, scores, strict=True):
                    out[r].append({"a": a, "b": b, "value": texts[r][a:b], "score": float(s), "is_secret": bool(s >= threshold)})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(o) for o in out], pa.int64()), pa.array(out, found_type)], names=[id_col, "n_candidates", "findings"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_candidates bigint, findings array<struct<a:int,b:int,value:string,score:double,is_secret:boolean>>")
