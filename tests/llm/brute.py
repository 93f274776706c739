"""Plain Python versions of the operators' base results."""

import hashlib
import re

ASSIGN = re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text: str | None) -> tuple:
    t = text or ""
    by = {
        "assign": [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32],
    }
    order = sorted((a, k, b, name) for k, (name, s) in enumerate(by.items()) for a, b in s)
    return *map(len, by.values()), digest([(name, a, b) for a, _, b, name in order])


def personal(text: str | None) -> tuple:
    t = text or ""
    by = {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15],
    }
    return *map(len, by.values()), digest([(name, a, b) for name, s in by.items() for a, b in s])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    dups, seen = 0, set()
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    grams: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    held = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dups, len(held), failed


def edited(rows: list[tuple]) -> dict:
    """doc_id: (n_chars, edited_sha256) of rows (doc_id, text) with distinct ids."""
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for k, (d, t) in enumerate(order):
        n = len(t) // 3
        e = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest())
    return out


def shingles(text: str | None, n: int = 4) -> frozenset:
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def components(rows: list[tuple], percent: int = 85) -> list[tuple]:
    """(doc_id, set size, component) of rows (doc_id, text) with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return [(d, len(sets[d]), top(d)) for d in ids]


TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
GIVEN = (
    "Anna|Maria|Laura|Julia|Sarah|Emma|Sophie|Marie|Lucia|Carmen|Elena|Alice|Claire|Nina|Eva|Clara|Susan|Linda|Karen|Lisa|Helen|Nancy|Emily|Jane|Mary|Alexander|Thomas|Michael|Peter|Paul|Daniel|David|Martin|"
    "Andreas|Stefan|Hans|Jean|Pierre|Louis|Antoine|Carlos|Jose|Juan|Luis|Miguel|Pablo|John|James|Robert|William|Richard|Charles|George|Mark|Steven|Kevin|Brian|Adam|Simon|Felix|Max|Jonas|Lukas|Hugo|Leo"
)
ENDS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|pl|ch|at|be|ca|us|au|br|in|jp|cn|ru"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CUES = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|address|login", "card": "card|visa|credit|debit|pay|account", "phone": "phone|tel|call|mobile|fax|sms|contact",
    "name": "name|contact|dear|sincerely|regards|signed|author|patient|customer",
}
H = "[0-9A-Fa-f]{1,4}"
CAP = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,24}"
LOOSE = {
    "email": [EMAIL, re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63})+")],
    "ip": [re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), re.compile(rf"(?<![0-9A-Za-z:])(?:(?:{H}:){{7}}{H}|(?:{H}:){{1,6}}:{H}(?::{H}){{0,5}})(?![0-9A-Za-z:])")],
    "card": [CARD],
    "phone": [PHONE, re.compile(r"(?<![0-9A-Za-z+.,(-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{2,5}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z-])")],
    "name": [re.compile(rf"(?<!\w)(?:(?:{TITLES})\.? )?{CAP}(?:[ -]{CAP}){{1,2}}(?![\w@])")],
}


def votes(kind: str, m: str, before: str) -> tuple:
    """Whether a candidate is of strict form, its three votes, and its looks."""
    digits = re.sub("[^0-9]", "", m)
    strict = {
        "email": lambda: "@" in m, "ip": lambda: "." in m and all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: m[0] == "+" and 9 <= len(digits) <= 15, "name": lambda: False,
    }[kind]()
    form = {
        "email": lambda: re.search(r"(?:\(at\)|\[at\]).*(?:\(dot\)|\[dot\]|\.)", m), "ip": lambda: re.fullmatch(f"(?:{H}:){{7}}{H}", m), "card": lambda: False, "phone": lambda: 9 <= len(digits) <= 15 and re.match(r"00|\(|0", m), "name": lambda: re.match(rf"(?:{TITLES})\b", m),
    }[kind]()
    end = re.search(rf"(?i)(?:\.|\]|\)|dot) ?({ENDS})$", m)
    listed = {
        "email": lambda: end, "ip": lambda: not re.match(r"(?:0+|127|22[4-9]|2[3-5][0-9])\.", m) and not re.match("(?i)0|f[ef]", m), "card": lambda: re.match(ISSUERS, digits), "phone": lambda: re.match(f"(?:{CALLING}|0[1-9])", re.sub("^00", "", digits)), "name": lambda: re.search(rf"\b(?:{GIVEN})\b", m),
    }[kind]()
    first = lambda x, g=0: x[g] if x else ""
    head = {
        "email": lambda: first(end, 1).lower(), "ip": lambda: "6" if ":" in m else "4", "card": lambda: first(re.match(ISSUERS, digits)), "phone": lambda: first(re.match(r"\+|00|0|\(", m)), "name": lambda: first(re.search(rf"\b({TITLES})\b", m)),
    }[kind]()
    size = min(len(m) if kind in ("email", "name") else len(re.sub("[^0-9A-Fa-f]", "", m)), 40)
    size = size // 4 if kind in ("email", "name") else size
    marks = "".join(sorted({c for c in m if not c.isalnum()}))[:4]
    left = "^" if not before else "a" if before[-1].isalpha() else "9" if before[-1].isnumeric() else "_" if before[-1] in " \t\n\x0b\x0c\r" else before[-1] if "!" <= before[-1] <= "~" else "*"
    cued = re.search(rf"\b(?:{CUES[kind]})", before.lower(), re.ASCII)
    return bool(strict), (int(bool(strict or form)), int(bool(listed)), int(bool(cued))), (head, size, marks, left)


def personal_spans(texts: list[str | None]) -> list[list[tuple]]:
    """All spans ``kind, start, end`` of each text by weak supervision, with soft labels from a straightforward EM and a naive Bayes of counts."""
    import numpy as np

    found = []
    for n, text in enumerate(texts):
        t = text or ""
        for kind, patterns in LOOSE.items():
            for p in patterns:
                last = 0
                for m in p.finditer(t):
                    before, last = t[last : m.start()][-32:], m.end()
                    if kind != "card" or 13 <= len(re.sub("[ -]", "", m[0])) <= 19:
                        found.append((n, kind, *m.span(), *votes(kind, m[0], before)))
        # Only texts that a given name or a title lets expect names are searched for them.
        if not re.search(rf"\b(?:{TITLES})\.? [A-ZÀ-Þ]|\b(?:{GIVEN})[ -][A-ZÀ-Þ]", t):
            found = [f for f in found if f[0] != n or f[1] != "name"]
    out: list[list[tuple]] = [[] for _ in texts]
    for kind in LOOSE:
        own = [f for f in found if f[1] == kind]
        if not own:
            continue
        v = np.array([f[5] for f in own], float)
        right, wrong, share = np.full(3, 0.8), np.full(3, 0.2), 0.5
        for _ in range(50):
            yes = share * np.prod(np.where(v == 1, right, 1 - right), axis=1)
            no = (1 - share) * np.prod(np.where(v == 1, wrong, 1 - wrong), axis=1)
            q = yes / (yes + no)
            share = (q.sum() + 1) / (len(q) + 2)
            right, wrong = (q @ v + 1.6) / (q.sum() + 2), ((1 - q) @ v + 0.4) / ((1 - q).sum() + 2)
        for f in own:
            score = np.log((q.sum() + 1) / ((1 - q).sum() + 1))
            for k in range(4):
                same = np.array([g[6][k] == f[6][k] for g in own])
                values = len({g[6][k] for g in own})
                score += np.log((q[same].sum() + 1) / (q.sum() + values)) - np.log(((1 - q)[same].sum() + 1) / ((1 - q).sum() + values))
            base = [g for g in found if g[0] == f[0] and g[4]]
            if f[4]:
                out[f[0]].append(f[1:4])
            elif score > 0 and not any(g[2] < f[3] and f[2] < g[3] for g in base):
                out[f[0]].append((f"{kind}_like", *f[2:4]))
    return [sorted(set(x)) for x in out]


def leaves(text: str | None) -> list[str]:
    return re.findall(r"[^.!?,;:\n]{1,64}[.!?,;:\n]*|[.!?,;:\n]+", text or "")


def tree(text: str | None) -> tuple[str, list[tuple[str, list[tuple[str, int]]]]]:
    """Root, and of each section its hash and the hashes and lengths of its paragraphs."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections, own, full = [], [], ""
    for p in leaves(text):
        h = sha(p)
        cut = h[0] == "0"
        own.append((h[:12], len(p)))
        full += f"{h}.{len(p)}" + ("" if cut else ",")
        if cut:
            sections.append((sha(full), own))
            own, full = [], ""
    if own:
        sections.append((sha(full), own))
    return sha("".join(h for h, _ in sections)), [(h[:16], x) for h, x in sections]


def alike(a: str | None, b: str | None) -> float:
    (ra, sa), (rb, sb) = tree(a), tree(b)
    if ra == rb:
        return 1.0
    x, y = {h: dict.fromkeys(p) and p for h, p in sa}, {h: p for h, p in sb}
    both = sum(n for h in x.keys() & y.keys() for _, n in x[h])
    p, q = ({e for h in s if h not in o for e in s[h]} for s, o in ((x, y), (y, x)))
    weight = lambda s: sum(n for _, n in s)
    return 2 * (both + weight(p & q)) / (2 * both + weight(p) + weight(q))


def changed(a: str | None, b: str | None) -> list[tuple[int, int]]:
    """Places of the paragraphs of ``a`` that ``b``'s differing sections lack."""
    (ra, sa), (rb, sb) = tree(a), tree(b)
    if ra == rb:
        return []
    ours, theirs = {h for h, _ in sa}, {h for h, _ in sb}
    other = {e for h, p in sb if h not in ours for e in p}
    out, at = [], 0
    for h, p in sa:
        for e in p:
            if h not in theirs and e not in other:
                out.append((at, at + e[1]))
            at += e[1]
    return out
