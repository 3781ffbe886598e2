"""Problem 2: credentials in source code and configuration, found and redacted in place.

Candidates come from assignment contexts (keys, flags, headers, addresses, comments) and from token shapes.  A candidate's literal
is segmented into words of a dictionary by Viterbi; what no word explains is its residual.  A residual near a sensitive key, or a
long one in a token's shape, is a secret; references, placeholders, public keys and known hash formats are not.
The dictionary is counted over the paths and configuration keys of the whole corpus.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.session import spread

# ---------------------------------------------------------------------------------------------------- fixed values

COMMON_WORDS = """about access account action active admin agent alert allow api app apply archive array audit auth author auto backup
base basic batch bearer block body bool bucket buffer build bundle cache call case cert change channel check class clean client cloud
code command common compose config connect console content context control cookie core count create current custom daemon data
database date debug default delete demo deploy dev device digest dir disabled disk docker domain down dummy edit email enabled engine
entry env error event example exec export expire external factory fail false feature fetch field file filter flag flow folder
format frame from front function gate gateway get global grant graph group guard handle header health hello host hourly http
image import index info init inner input insert instance internal item job json key kind lab label lang last layer level
library limit line link list load local lock log login logout main manager map mark master match max member memory message meta
method min mode model module monitor name net network never nightly node none null oauth object open option order outer
output owner package page pair param parse partial path payload pending permission pipe placeholder plan plugin point policy
pool port portal post prefix private process prod profile project prompt protocol provider proxy public publish pull push query
queue raw read ready real record ref refresh region register release remote render replica report request required reset
resource response rest result retry role root route rule run safe sample save scan schema scope score script search secret section
secure select send server service session set setting shared show sign simple single size socket sort source spec stage stale start
state static status step stop storage store stream strict string style sync system table tag target task team temp template tenant
test text thread ticket time timeout title token tool trace track tree trial true trust type unit update upload url user
util valid value vault version view wait watch web weighted west word work worker workspace write zone""".split()
SENSITIVE = frozenset(
    """password passwd passphrase passwort passcode pwd pw pass secret secrets token tokens apikey apisecret apitoken credential
    credentials creds cred kennwort clave contrasena contraseña motdepasse mdp geheimnis senha wachtwoord auth authtoken authkey
    authorization accesskey secretkey privatekey signingkey encryptionkey clientsecret dbpass dbpassword userpass smtppass""".split()
)
KEYED = frozenset("api private secret signing encryption access auth master shared service account admin session storage deploy license hmac webhook ssh jwt cipher crypto subscription".split())
HARMLESS = frozenset(
    """file files path dir ref refs name names policy policies ttl mode modes id ids length min max limit hint url uri
    type types count expiry expires expiration expire size prefix suffix regex pattern validator reset bucket buckets public
    enabled required rotation rotate algorithm algo method provider endpoint placeholder strength history age lifetime usage
    days hours minutes seconds timeout retries scope scopes audience issuer""".split()
)
_REFERENCE = re.compile(
    r"""^(?:\$\{.*|\$\(.*|\$\w+|%\w+%|\{\{.*|<[^<>]*>?|\[[^\]]*\]|@\w+@|@[\w.]+|\#\{.*|`.*|%\(.*
    |(?:vault|file|env|secret|secrets|ssm|arn|op|awskms|gcpkms|kms|sops|keyring|ref|config|consul|aws-sm|doppler|azurekv|secretref|keychain)[:/].*
    |(?:os|process|env|system|sys|config|settings|self|this|ctx|viper|secrets|vault|options|opts|props|args)[.\[].*|(?:getenv|require|input|prompt|read\w*|get\w*|load\w*|fetch\w*)\(.*
    |~?\.{0,2}/[\w./~-]+|[A-Za-z]:\\.*|[\w.-]+\.(?:pem|key|crt|txt|json|ya?ml|env|cfg|ini|toml|jks|p12|pfx)
    |(?:https?|wss?|ftp|ssh|git|s3|gs)://\S*|ssh-(?:rsa|ed25519|dss)\b.*|ecdsa-sha2\S*.*|-----BEGIN\s(?!.*PRIVATE).*
    |sha(?:1|224|256|384|512)[-:].*|md5[-:].*|\d+(?:ms|s|m|h|d|w|y|kb|mb|gb|%)?|\d+(?:\.\d+)+|\d{4}-\d\d-\d\d.*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|v?\d+\.\d+.*)$""",
    re.X | re.I,
)
_PLACEHOLDER = re.compile(
    r"""(?:^|[^a-z])(?:your|my|the|some|insert|enter|put|add|set|change|replace)[-_ ]?(?:me|own|this|it|here|with|in|to|token|secret|password|key|api|value|real|a|an|the)?(?:[^a-z]|$)
    |change[-_]?(?:me|it)|replace[-_]?me|placeholder|example|redacted|dummy|sample|not[-_]?set|unset|todo|fixme|tbd|fake|foobar|lorem|^x{3,}|^\*{3,}|^\.{3,}|^-+$|x{6,}|\*{4,}|^0+$|^(?:null|none|nil|undefined|true|false|yes|no|on|off|test|testing|secret|password|passwd|token|n/?a|empty|default)$|123456(?:78(?:90?)?)?$""",
    re.X | re.I,
)
# Fixed patterns: hashes that name their own kind are no credentials anywhere; bare hexadecimal ones only beside a key that names one.
_DIGEST = re.compile(r"^(?:\$(?:1|2[abxy]?|5|6|y|argon2\w*|scrypt|pbkdf2[\w-]*)\$|\{(?:SSHA|SHA|MD5|CRYPT)\d*\}|(?:sha\d+|md5|blake\w+|crc\d*|pbkdf2_sha\d+|bcrypt)[-:=$_])", re.I)
_HASH = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")
# Fixed patterns: how tokens of well-known kinds begin, and what follows.
TOKEN_SHAPES = [
    (r"gh[pousr]_", r"[A-Za-z0-9_]{16,}"), (r"github_pat_", r"[A-Za-z0-9_]{16,}"), (r"glpat-", r"[\w-]{16,}"), (r"[srp]k_(?:live|test)_", r"[A-Za-z0-9]{10,}"), (r"(?:AKIA|ASIA)", r"[0-9A-Z]{12,}"), (r"AIza", r"[\w-]{20,}"),
    (r"xox[abeoprs]-", r"[\w-]{12,}"), (r"[a-z]{2,8}_(?:pat|key|token|secret|live|prod)_", r"[A-Za-z0-9]{16,}"), (r"npm_", r"[A-Za-z0-9]{24,}"), (r"pypi-", r"[\w-]{24,}"), (r"SG\.", r"[\w-]{12,}\.[\w-]{12,}"), (r"hvs\.", r"[\w-]{20,}"),
    (r"dop_v1_", r"[0-9a-f]{32,}"), (r"ya29\.", r"[\w-]{20,}"), (r"sk-", r"[A-Za-z0-9_-]{24,}"), (r"eyJ", r"[\w-]{8,}\.[\w-]{6,}\.[\w-]{10,}"),
]
_TOKENS = re.compile(r"(?<![A-Za-z0-9_/+-])(?:" + "|".join(f"(?:{head}){body}" for head, body in TOKEN_SHAPES) + ")")
_SHAPE = re.compile("(?:" + "|".join(head for head, _ in TOKEN_SHAPES) + ")")
_HOOK = re.compile(r"https?://(?:hooks?|webhooks?)\.[\w.-]+/(\S*?[A-Za-z0-9]{16,}[^\s\"'`;,)]*)", re.I)
_URL = re.compile(r"(?P<scheme>[a-z][a-z0-9+.-]{1,20})://(?P<user>[^\s:/@\"'`<>{}]*):(?P<pass>[^\s/@\"'`]{3,})@(?=[\w\[{$<-])", re.I)
_QUERY = re.compile(r"[?&;](?P<key>[\w.-]+)=(?P<value>[^\s&;\"'`<>)]{6,})")
_SCHEME = re.compile(r"(?<![\w-])(?P<key>bearer|basic|token|apikey|digest|negotiate)[ ]+(?P<value>[A-Za-z0-9][A-Za-z0-9+/=._~!@#$%^*-]{7,})", re.I)
_FLAG = re.compile(r"(?<![\w-])--?(?P<key>[A-Za-z][\w.-]*)(?:=|\s+)(?P<value>\"[^\"\n]*\"|'[^'\n]*'|[^\s\"';|&]+)")
_PAIR = re.compile(
    r"""(?P<q>["']?)(?<![\w$-])(?<!\w\.)(?P<key>[^\W\d][\w.-]*+)(?P=q)\s*+(?:\]\s*+)?(?::\s*+[\w.\[\]<>|?]++\s*+=(?=\s*+["'`(])|:=|=>|=(?!=)|:(?!:))\s*+(?:\(\s*+)?
        (?P<value>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s"'`{\[(]|\{\{)""",
    re.X,
)
_ENV = re.compile(r"^\s*ENV\s+(?P<key>\w+)\s+(?P<value>\S[^\n]*)$", re.I)
_CALL = re.compile(r"""(?<![\w.])(?P<key>[\w.]+)["']?\s*,\s*(?P<value>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""")
_LOOSE = re.compile(r"(?:^|[\s#/*;!]|(?<!\w)-)(?P<key>[^\W\d][\w-]*+)(?:\s*+(?:is|was|:|=|->))?\s++(?P<value>[\"'`]?[^\s\"'`,;]{6,})", re.U)
_JOINED = re.compile(r"""(?P<first>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?P<rest>(?:[ \t]*\\?\n?[ \t]*[+.]?[ \t]*\\?\n?[ \t]*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))+)""")
_ASSIGNED = re.compile(r"""(?<![\w.$-])(?P<key>[\w.$-]++)["']?\s*+(?::\s*+[\w.\[\]<>|]++\s*+)?(?::=|=|:|,)\s*+(?:\(\s*+)?(?=["'])""")
_HINT = re.compile(
    r"""(?:(?:\b(?:zugang|access|login|logon|prod|production|staging|was|old|former|current|live|temp|test\w*|acceso|acc[eè]s|connexion|key|value|creds?|user)\b[^:=>\n]{0,30}?(?::|->|=>?|\bwas\b|\bis\b))|\buse\b|\btry\b)\s+
        ["'`]?(?P<value>[^\s"'`,;]{7,})""",
    re.X | re.I,
)
_STOP = re.compile(r"(?<!\s)\s++(?:#|//|&&|\|\||;)|[,;]\s*+$|[\"'`]|(?<!\s)\s*+[)}\]]++[;,]?+\s*+$")
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""")
_OPEN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_CLOSE = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:[\s\"'+#*/>|,\\n]*+[A-Za-z0-9+/=]{24,}+[\"',+\\]*+)*+(?:[\s\"'+#*/>|,\\n]*+[A-Za-z0-9+/]++={0,2}(?=[\"'`\s,+\\]*+\Z))?")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|\"\"\"|''')|\s(?:#|//|--)\s")
_HEADER = re.compile(r"(?i)authorization|header")
_GATE = re.compile(
    r"pass|pwd|pw\b|secret|token|key|auth|bearer|basic |cred|kennwort|clave|contrase|mdp|geheim|senha|wachtwoord|://[^\s/:]*+:[^\s/]*@|hook|zugang|prod|staging|login|was|\buse |\bold |\btry |acc[eè]s|"
    + "|".join(head if "\\w" in head else head.lower() for head, _ in TOKEN_SHAPES)
)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_QUOTED_LANGUAGES = frozenset("py js ts jsx tsx mjs cjs go java css c h cpp rs rb php kt swift scala sql csv".split())

# ------------------------------------------------------------------------------------------------------- Viterbi


class Dictionary:
    """Unigram word model; :meth:`residual` counts the characters that the best segmentation leaves unexplained."""

    UNKNOWN = 9.0

    def __init__(self, words: dict[str, int]):
        counts = {w: 5 for w in COMMON_WORDS if len(w) > 2}
        for w, n in words.items():
            counts[w] = counts.get(w, 0) + n
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, self.cost), default=1)
        self.memo: dict[str, int] = {}

    def residual(self, text: str) -> int:
        got = self.memo.get(text)
        if got is None:
            got = self._residual(text.lower())
            if len(text) <= 256:  # longer ones are segmented anew, so that memory stays bounded
                if len(self.memo) > 50_000:
                    self.memo.clear()
                self.memo[text] = got
        return got

    def _residual(self, text: str) -> int:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            cost, left = best[end - 1]
            now = (cost, left) if not text[end - 1].isalnum() else (cost + self.UNKNOWN, left + 1)
            for size in range(3, min(end, self.longest) + 1):
                word = self.cost.get(text[end - size : end])
                if word is not None and best[end - size][0] + word < now[0]:
                    now = (best[end - size][0] + word, best[end - size][1])
            best.append(now)
        return best[-1][1]


# ------------------------------------------------------------------------------------------------------ detector


def sensitive(key: str) -> bool:
    """True where a key names a credential itself, not its file, length, policy or the like."""
    words = [w.lower() for p in re.split(r"[\W_]+", key) for w in _CAMEL.split(p) if w]
    words = [re.sub(r"\d+$", "", w) or w for w in words]
    if not words or words[0] in ("is", "has", "use", "require", "requires", "needs", "with", "count", "min", "max", "num", "no"):
        return False
    for i, word in enumerate(words):
        keyed = word in ("key", "keys") and i > 0 and words[i - 1] in KEYED
        french = word == "passe" and words[max(0, i - 2) : i] == ["mot", "de"]
        if keyed or french or word in SENSITIVE:
            return not (HARMLESS & set(words[i + 1 :])) and "public" not in words
    return "motdepasse" in "".join(words) and words[-1] not in HARMLESS


# Words of prose, which no passphrase has.
PROSE = frozenset("a an and are as at be by can do does for from has have if in is it its may must no not of on one only or set should than that the them then this to use used uses was when will with you your".split())
PHRASED = frozenset("password passwd passphrase passwort passcode pwd kennwort contrasena contraseña clave secret".split())


def passphrase(value: str) -> bool:
    """Four or more plain words in a row that make no sentence."""
    words = value.split()
    return len(words) >= 4 and all(w.isalpha() and w.islower() and len(w) > 2 for w in words) and not PROSE & set(words) and len(set(words)) == len(words)


class Detector:
    """Spans of usable credentials in the text of a file; one per task."""

    def __init__(self, words: dict[str, int]):
        self.words = Dictionary(words)

    def usable(self, value: str, strong: bool) -> bool:
        """Whether a literal is a credential, by what its segmentation leaves unexplained; ``strong`` beside a sensitive key, otherwise
        only in the shape of a token.  Literals below six characters are none, nor are those in the format of a hash; a bare
        hexadecimal one beside a sensitive key is a hexadecimal key."""
        v = value.strip()
        if len(v) < 6 or _REFERENCE.match(v) or _DIGEST.match(v) or "://" in v or " " in v and not strong:
            return False
        left = self.words.residual(v)
        if _TOKENS.fullmatch(v):
            return left >= 6
        if _PLACEHOLDER.search(v) or v.count("${") or "{{" in v or not strong:
            return False
        if " " in v:
            return passphrase(v)
        if _HASH.match(v):
            return left >= 6
        digits = sum(c.isdigit() for c in v)
        if v.isdigit():
            return left >= 8
        if v.isalpha():
            return left >= 6 and (len(v) >= 16 or any(c.isupper() for c in v[1:]) and any(c.islower() for c in v)) and left > 0.6 * len(v)
        if not digits and left < 0.4 * sum(c.isalnum() for c in v):
            return False
        return left >= 2 and len(v) >= 7 or left >= 6

    def in_address(self, v: str) -> bool:
        """Whether the password of an address is one: no reference or placeholder, and more than a word that only says so."""
        named = v.lower() in ("pass", "password", "pwd", "pw", "secret", "token", "user")
        return not (_REFERENCE.match(v) or _PLACEHOLDER.search(v) or "{" in v or v[:1] == "$" or named) and (self.words.residual(v) >= 2 or len(v) >= 6)

    def spans(self, text: str, ext: str) -> list[tuple[int, int]]:
        """(start, end) of every credential in the text, in order; spans of multi-line keys cover all of their lines."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        ends = [m.start() for m in re.finditer("\n", text)]
        lines = list(dict.fromkeys(bisect.bisect_left(ends, m.start()) for m in _GATE.finditer(low)))
        if not lines:
            return []
        found = self._keys(text)
        blocked = [(a, b) for a, b in found]
        quoted = ext in _QUOTED_LANGUAGES
        for k in lines:
            start = ends[k - 1] + 1 if k else 0
            end = ends[k] if k < len(ends) else len(text)
            if any(a <= start and end <= b for a, b in blocked):
                continue
            found += [(start + a, start + b) for a, b in self._line(text[start:end].rstrip("\r"), quoted)]
        found += self._joined(text, low, ends, lines)
        out: list[tuple[int, int]] = []
        for a, b in sorted(set(found)):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _keys(self, text: str) -> list[tuple[int, int]]:
        """Private keys from their opening to their closing line, or to where the key breaks off; their body is unexplained too."""
        out = []
        opens, closes = list(_OPEN.finditer(text)), list(_CLOSE.finditer(text))
        starts = [c.start() for c in closes]
        for m, again in zip(opens, [*opens[1:], None]):
            k = bisect.bisect_left(starts, m.end())
            if k < len(closes) and (again is None or starts[k] < again.start()):
                end, body = closes[k].end(), text[m.end() : starts[k]]
            else:
                end = _BODY.match(text, m.end()).end()
                body = text[m.end() : end]
            if self.words.residual(body) >= 6:
                out.append((m.start(), end))
        return out

    def _line(self, line: str, quoted: bool) -> Iterator[tuple[int, int]]:
        """Spans in a line of any length; every pattern reads it once."""
        mark = _COMMENT.search(line)
        comment, header = mark and mark.start(), bool(_HEADER.search(line))
        for m in _TOKENS.finditer(line):
            if not _PLACEHOLDER.search(m.group()) and self.words.residual(m.group()) >= 6:
                yield m.span()
        for m in _HOOK.finditer(line):
            if self.words.residual(m.group(1)) >= 6:
                yield m.span(1)
        for m in _URL.finditer(line):
            if self.in_address(m.group("pass")):
                yield m.span("pass")
        for m in _QUERY.finditer(line):
            if sensitive(m.group("key")) and self.usable(m.group("value"), True):
                yield m.span("value")
        for m in _SCHEME.finditer(line):
            v = m.group("value")
            if m.group("key").lower() in ("token", "digest") and not header:
                continue
            if self.usable(v, True):
                yield m.span("value")
        for m in _FLAG.finditer(line):
            if sensitive(m.group("key")) and (got := self._value(line, m, False)):
                yield got
        at = 0
        while m := _PAIR.search(line, at):
            at = max(m.start() + 1, m.end() if m.group("value")[0] in "\"'`" else m.start("value"))
            if sensitive(m.group("key")) and (got := self._value(line, m, quoted and comment is None, True)):
                yield got
        if (m := _ENV.match(line)) and sensitive(m.group("key")) and (got := self._value(line, m, False)):
            yield got
        for m in _CALL.finditer(line):
            if sensitive(m.group("key")) and (got := self._value(line, m, True)):
                yield got
        if comment is not None:
            for m in _LOOSE.finditer(line):
                v = m.group("value")
                if sensitive(m.group("key")) and (got := self._value(line, m, False)):
                    if any(c.isdigit() for c in v) and self.words.residual(v.strip("\"'`")) >= 2:
                        yield got
            for m in _HINT.finditer(line, comment):
                v = m.group("value").rstrip(".)!?*/") if not m.group("value").rstrip().endswith("!") else m.group("value")
                mixed = any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
                shaped = any(not c.isalnum() for c in v) or any(c.isupper() for c in v) and any(c.islower() for c in v)
                if mixed and (shaped or _HASH.match(v) and len(v) < 65) and not re.search(r"[()\\:<>\[\]]|\w\.[a-z]\w{0,3}$", v) and not ("/" in v and len(v) < 30) and self.usable(v, True):
                    yield m.start("value"), m.start("value") + len(v)

    def _value(self, line: str, m: re.Match, quoted: bool, rest: bool = False) -> tuple[int, int] | None:
        """The span of the literal of a pair if it is usable.  In code only a quoted literal is one.  With ``rest`` the pattern has
        only found where an unquoted one starts."""
        start, end = m.span("value")
        if line[start] in "\"'`" and end - start > 1 and line[end - 1] == line[start]:
            start, end = start + 1, end - 1
        elif quoted:
            return None
        else:
            v = line[start:] if rest else line[start:end]
            stop = _STOP.search(v)
            first = v.split(None, 1)[0] if v.strip() else v
            whole = v
            v = v[: stop.start()].rstrip() if stop else v.rstrip()
            if ";" in v and re.search(r";\s*\w+=", v) or re.match(r"[^\s;]+;", v):
                v = v.split(";")[0]
            if " " in v:
                v = first if re.search(r"\s(?:&&|\|\||;)", whole) else v
            end = start + len(v)
            if start and v[:1] in "\"'`":
                start += 1
        v = line[start:end]
        return (start, end) if self.usable(v, True) else None

    def _joined(self, text: str, low: str, ends: list[int], lines: list[int]) -> Iterator[tuple[int, int]]:
        """Literals put together from parts: the parts count as one literal, on every line that holds one of them."""
        chains = [[(s.start() + 1, s.end() - 1) for s in _STRING.finditer(text, m.start(), m.end())] for m in _JOINED.finditer(text)]
        lasts = [c[-1][1] for c in chains]
        for k in lines:
            start = ends[k - 1] + 1 if k else 0
            line_end = ends[k] if k < len(ends) else len(text)
            head = text[start:line_end]
            opened = re.match(r"""\s*(?:[\w$]+\s+)*?(?P<key>[\w.$-]+)["']?\s*(?::\s*[\w.\[\]<>|]+\s*)?(?::=|=|:)\s*\(?\s*\\?\s*$""", head)
            if opened and sensitive(opened.group("key")):
                m = re.compile(r"""\s*(?P<first>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?P<rest>(?:\s*\\?\s*\+?\s*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))*)""").match(text, line_end)
                if m:
                    parts = [(s.start() + 1, s.end() - 1) for s in _STRING.finditer(text, m.start(), m.end())]
                    if self.usable("".join(text[a:b] for a, b in parts), True):
                        yield from parts
                continue
            keys = {m.end(): m.group("key") for m in _ASSIGNED.finditer(text, start, line_end)}
            for i in range(bisect.bisect_left(lasts, start), len(chains)):
                parts = chains[i][bisect.bisect_left(chains[i], (start, start)) :]
                if not parts or parts[0][0] - 1 > line_end:
                    break
                if len(parts) < 2:
                    continue
                value = "".join(text[a:b] for a, b in parts)
                strong = sensitive(keys.get(parts[0][0] - 1, ""))
                if self.usable(value, strong) or _SCHEME.fullmatch(value) and self.usable(value.split()[-1], True):
                    yield from ((a, b) for a, b in parts if b > a)


# ------------------------------------------------------------------------------------------------------ operators

LEAST_SHARE = 1e-5


def corpus_words(files: DataFrame, configs: DataFrame, least: int = 3, share: float = LEAST_SHARE) -> dict[str, int]:
    """The dictionary: words of all paths and configuration keys that make up at least ``share`` of all of their words, and occur
    ``least`` times.  No more than 1 / ``share`` words can, whatever the size of the corpus."""
    texts = files.select(F.col("file_path").alias("t")).unionByName(configs.select(F.col("config_key").alias("t")))
    words = texts.select(F.explode(F.split(F.regexp_replace("t", "([a-z0-9])([A-Z])", "$1 $2"), r"[^\p{L}]+")).alias("w"))
    counts = words.filter(F.length("w").between(3, 20)).groupBy(F.lower("w").alias("w")).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return {r["w"]: r["count"] for r in counts.filter(F.col("count") >= max(least, share * total)).collect()}


_SPANS = "file_id long, line_no int, start_char int, end_char int"


def one_line():
    """The lines of a file without newlines in them."""
    return F.transform("file_lines", lambda x: F.translate(F.coalesce(x, F.lit("")), "\n", " "))


def find_in_files(files: DataFrame, words: dict[str, int], keep: bool = False) -> DataFrame:
    """Credential spans of every line: file_id, line_no, start_char and end_char (exclusive) within the line, with ``keep`` line_text.

    A null or empty line list gives none, null elements count as empty lines.  Repeated deliveries give repeated rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(words)
        for b in batches:
            rows = []
            for file_id, ext, text in zip(b["file_id"], b["ext"], b["text"]):
                found = line_spans(text, detector.spans(text, ext))
                parts = text.split("\n") if keep and found else []
                rows += [(file_id, *r, *([parts[r[0] - 1]] if keep else [])) for r in found]
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "start_char", "end_char", *["line_text"] * keep]).astype({"line_no": "int32", "start_char": "int32", "end_char": "int32"})

    ext = F.lower(F.coalesce(F.regexp_extract("file_path", r"\.([^./]+)$", 1), F.lit(""))).alias("ext")
    return spread(files.filter("file_lines is not null").select("file_id", ext, F.array_join(one_line(), "\n").alias("text"))).mapInPandas(run, _SPANS + ", line_text string" * keep)


def line_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans of a text as (line from 1, start, end) of every line they touch."""
    if not spans:
        return []
    ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    out = []
    for a, b in spans:
        k = bisect.bisect_left(ends, a)
        while True:
            start = ends[k - 1] + 1 if k else 0
            low, high = max(a, start), min(b, ends[k])
            if high > low:
                out.append((k + 1, low - start, high - start))
            if b <= ends[k] or k + 1 >= len(ends):
                break
            k += 1
    return out


_CONFIG_SPANS = "config_id long, file_id long, line_no int, config_value string, start_char int, end_char int"


def _config_spans(detector: Detector, key: str | None, value: str | None) -> list[tuple[int, int]]:
    """Credential spans within a configuration value, read beside its key."""
    head = f"{key or 'value'}="
    return [(max(a - len(head), 0), e - len(head)) for a, e in detector.spans(head + (value or "").replace("\n", " "), "env") if e > len(head)]


def find_in_configs(configs: DataFrame, words: dict[str, int]) -> DataFrame:
    """Lines whose configuration value holds a credential: file_id, line_no, config_id, config_value, start_char and end_char within the value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(words)
        for b in batches:
            rows = []
            for config_id, file_id, line, key, value in b.itertuples(index=False, name=None):
                rows += [(config_id, file_id, line, value, *span) for span in _config_spans(detector, key, value)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CONFIG_SPANS.split(", ")]).astype({"config_id": "Int64", "file_id": "Int64", "line_no": "Int32", "start_char": "int32", "end_char": "int32"})

    rows = configs.select("config_id", "file_id", "line_no", "config_key", "config_value").filter(F.length("config_value") > 5)
    return rows.mapInPandas(run, _CONFIG_SPANS)


def find_lines(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Distinct (file_id, line_no) with a credential in the file's line or in the configuration value read from it."""
    words = corpus_words(files, configs)
    seen = find_in_files(files, words).select("file_id", "line_no").unionByName(find_in_configs(configs, words).select("file_id", "line_no"))
    return seen.filter("line_no is not null").distinct()


def redact(text: str, spans: list[tuple[int, int]], mark: str = "REDACTED") -> str:
    """The text with every span replaced; line breaks inside a span stay, so that later lines keep their numbers."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "\n".join(mark if part.strip() else part for part in text[a:b].split("\n"))]
        at = b
    return "".join(out) + text[at:]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def _occurrences(text: str, part: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(part), text)] if part else []


def in_line(line: str, value: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where the span of a configuration value stands in the line it was read from; the literal alone where the value was changed in reading."""
    whole = [(at + start, at + end) for at in _occurrences(line, value)]
    return whole or [(at, at + end - start) for at in _occurrences(line, value[start:end])]


def in_value(value: str, line: str, start: int, end: int) -> list[tuple[int, int]]:
    """The part of a line's span that lies in the configuration value read from the line; the literal alone where the value was changed in reading."""
    starts = _occurrences(line, value)
    if not starts:
        return [(at, at + end - start) for at in _occurrences(value, line[start:end])]
    cut = [(max(start - at, 0), min(end - at, len(value))) for at in starts]
    return [(a, b) for a, b in cut if b > a]


def redact_files(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Every file once, its last delivery, with ``redacted_text`` (lines joined by newlines) and ``redacted_count``; null lines stay null.

    What only the configuration values give away is redacted in their lines too."""
    words = corpus_words(files, configs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(words)
        for b in batches:
            rows = []
            for file_id, ext, text, flat, sizes, told in zip(b["file_id"], b["ext"], b["text"], b["flat"], b["sizes"], b["told"]):
                spans = detector.spans(text if flat is None else flat, ext) if text else []
                if text and told is not None:
                    starts = [0]
                    for n in sizes:
                        starts.append(starts[-1] + n + 1)
                    for t in told:
                        if 0 < t["line_no"] < len(starts):
                            at = starts[t["line_no"] - 1]
                            line = text[at : starts[t["line_no"]] - 1]
                            spans = spans + [(at + x, at + y) for x, y in in_line(line, t["config_value"], t["start_char"], t["end_char"])]
                    spans = _merged(spans)
                rows.append((file_id, text if text is None else redact(text, spans), len(spans)))
            yield pd.DataFrame(rows, columns=["file_id", "redacted_text", "redacted_count"]).astype({"file_id": "Int64"})

    told = find_in_configs(configs, words).filter("line_no is not null and file_id is not null")
    told = told.groupBy("file_id").agg(F.collect_set(F.struct("line_no", "config_value", "start_char", "end_char")).alias("told"))
    last = files.groupBy("file_id").agg(F.max_by(F.struct("file_path", "file_lines"), F.struct("ingested_at", F.xxhash64("file_lines"))).alias("f")).select("file_id", "f.*")
    ext = F.lower(F.coalesce(F.regexp_extract("file_path", r"\.([^./]+)$", 1), F.lit(""))).alias("ext")
    # as find_in_files reads it: a newline within an element is no line end
    flat = F.when(F.exists("file_lines", lambda x: x.contains("\n")), F.array_join(one_line(), "\n"))
    sizes = F.transform("file_lines", lambda x: F.coalesce(F.length(x), F.lit(0)))
    rows = last.join(told, "file_id", "left").select("file_id", ext, F.when(F.col("file_lines").isNotNull(), F.array_join("file_lines", "\n", "")).alias("text"), flat.alias("flat"), F.when(F.col("told").isNotNull(), sizes).alias("sizes"), "told")
    return rows.mapInPandas(run, "file_id long, redacted_text string, redacted_count int")


def redact_configs(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Every configuration entry once, its last delivery, with ``redacted_value`` and ``redacted_count``; null values stay null.

    What only the entry's line in the file gives away, as in a key of many lines, is redacted in the value too."""
    words = corpus_words(files, configs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(words)
        for b in batches:
            rows = []
            for config_id, key, value, told in zip(b["config_id"], b["config_key"], b["config_value"], b["told"]):
                spans = _config_spans(detector, key, value) if value and len(value) > 5 else []
                for t in told if value and told is not None else []:
                    spans = spans + in_value(value, t["line_text"], t["start_char"], t["end_char"])
                spans = _merged(spans)
                rows.append((config_id, value if value is None else redact(value, spans), len(spans)))
            yield pd.DataFrame(rows, columns=["config_id", "redacted_value", "redacted_count"]).astype({"config_id": "Int64"})

    asked = configs.select("file_id").filter("file_id is not null").distinct()
    lined = files.filter("file_lines is not null").join(asked, "file_id", "left_semi")
    spans = find_in_files(lined, words, keep=True)
    told = spans.groupBy("file_id", "line_no").agg(F.collect_set(F.struct("line_text", "start_char", "end_char")).alias("told"))
    columns = ["file_id", "line_no", "config_key", "config_value"]
    last = configs.groupBy("config_id").agg(F.max_by(F.struct(*columns), F.struct("ingested_at", F.xxhash64(*columns))).alias("c")).select("config_id", "c.*")
    rows = last.join(told, ["file_id", "line_no"], "left")
    return rows.select("config_id", "config_key", "config_value", "told").mapInPandas(run, "config_id long, redacted_value string, redacted_count int")
