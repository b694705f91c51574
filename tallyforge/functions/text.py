"""Text rules for scanned words, names, paths and settings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element transform works as
    a let, since a lambda variable isn't recomputed at each use, least of all
    for each element inside another lambda."""
    return F.transform(F.array(value), body)[0]


def folded(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


#: Look-alikes of plain characters.
SAME = {"é": "e", "‘": "'", "’": "'", "“": '"', "”": '"'}


def sanitized(c: Column) -> Column:
    """Scanned text: look-alikes replaced, only letters, digits, white space
    and ."() kept, a leading voting target (O or 0) dropped, trimmed."""
    c = F.translate(c, "".join(SAME), "".join(SAME.values()))
    return F.trim(folded(c, [(r'[^a-zA-Z0-9\s."()]', ""), (r"^.?[O0]\s?", "")]))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def line_count(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1).cast("int")


# Misread forms of "write-in", and party codes after a name, of
# which one letter may have been misread.
WRITE_INS = "(write-in)|(witeing)|(wnte-in)|W[rha]ite In"
PARTY_CODES = ["REP", "DEM", "NPA", "LIB", "GRN", "REF"]
PARTY_END = "|".join(PARTY_CODES + [c[:i] + "." + c[i + 1 :] for i in range(3) for c in PARTY_CODES])


def clean_name(c: Column, writein: str = "write-in:") -> Column:
    """A candidate's name: write-in variants made one, marks before it and a
    party code after it dropped, "Yes" put right."""
    c = F.when(c.rlike(f"(?i){WRITE_INS}"), writein).otherwise(c)
    return folded(c, [(r"^\s*(@|\([cr]\))*\s*", ""), (rf"\s*({PARTY_END})$", ""), ("^[YV][ea]s$", "Yes")])


def ballot_id(path: Column) -> Column:
    """Base name without extension; digits and underscores only; of four
    groups the last is dropped."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(base, "[^0-9_]", ""), r"^(\d{5}_\d{5}_\d{5,})_\d+$", "$1")


def folder(path: Column, n: int) -> Column:
    """The n-th folder of a path with either separator; '' for n = -1, null
    beyond the last."""
    if n < 0:
        return F.lit("")
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) - 1 > n, F.get(parts, F.lit(n)))


def full_match_any(c: Column, patterns: list[str], empty: bool = False) -> Column:
    out = F.lit(empty) if not patterns else F.lit(False)
    for p in patterns:
        out = out | c.rlike(f"^(?:{p})$")
    return out


def group_one(c: Column, pattern: str, default: Column | None = None, dequote: bool = False) -> Column:
    """The pattern's first group, '' where it doesn't match (a dot matches line
    ends too); without a pattern the default, or the text itself."""
    if dequote:
        c = F.translate(c, "\"'", "")
    return F.regexp_extract(c, f"(?s){pattern}", 1) if pattern else (c if default is None else default)


def precinct(path: Column, name_pattern: str = "", folder_pattern: str = "", n: int = -1) -> Column:
    """By the file's name, else by the n-th folder, else ''."""
    by_name = F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), name_pattern, 1) if name_pattern else F.lit("")
    by_folder = F.coalesce(F.regexp_extract(folder(path, n), folder_pattern, 1) if folder_pattern else folder(path, n), F.lit(""))
    return F.when(by_name != "", by_name).otherwise(by_folder)


def header(c: Column) -> Column:
    """A column's name without space around, with single underscores inside."""
    return F.regexp_replace(F.replace(F.trim(c), F.lit(" "), F.lit("_")), "__+", "_")


def style_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"^\D+", "")


# Number words, one per value from 0.
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def number_word(c: Column) -> Column:
    """The first word that names a digit ("Vote for One" is 1), else null."""
    words = F.split(F.regexp_replace(F.lower(c), r"\p{Punct}", " "), r"\s+")
    at = F.transform(words, lambda w: F.array_position(F.lit(UNITS), w))
    return F.get(F.filter(at, lambda i: i > 0), F.lit(0)).cast("int") - 1


def column_title(c: Column) -> Column:
    """Spreadsheet title of a column's number from 1: 27 is AA1."""
    digits = F.aggregate(
        F.sequence(F.lit(0), F.lit(6)), F.struct(c.cast("long").alias("n"), F.lit("").alias("s")),
        lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).alias("n"), F.concat(F.char(65 + (a["n"] - 1) % 26), a["s"]).alias("s"))).otherwise(a),
        lambda a: a["s"],
    )
    return F.concat(digits, F.lit("1"))


def vote_for(option: Column) -> Column:
    return F.regexp_extract(option, r"vote_for\s*=\s*(\d+)", 1).try_cast("int")


def chunk_parts(name: Column) -> Column:
    """struct(archive, chunk) of a chunk file's name."""
    cut = lambda g: F.regexp_extract(name, r"^(.*)_chunk_(.*)\.csv$", g)
    return F.struct(cut(1).alias("archive"), cut(2).alias("chunk"))


def bucket_path(url: Column) -> Column:
    """struct(scheme, bucket, prefix, name) of an object's address."""
    cut = lambda g: F.regexp_extract(url, r"^([a-z0-9]+)://([^/]+)/(?:(.*)/)?([^/]*)$", g)
    return F.struct(*[cut(i).alias(k) for i, k in enumerate(("scheme", "bucket", "prefix", "name"), 1)])


# Misread common words on printed summaries, in upper case, in
# the order in which they are put right; the last two only in short lines.
SUMMARY_WORDS = [
    (r"[WHM]U[WN][I1L!l|T]C[I1L!l|T][FP]A[L\\!]", "MUNICIPAL"), (r"SCH[ODU0GC@][ODU0GC@][L\\!]", "SCHOOL"), (r"[Q@][I1L!l|]", "Q1"), ("[Q@]2", "Q2"),
    ("[J3]U[D0OB]G[EF]", "JUDGE"), (r"[DO0B][I1L!l|T]STR[I1L!l|T]C[TY1]", "DISTRICT"), ("W/[I1L!l|]", "W/I"), ("[RK][EF]F[EF][RK][EF]N[D0O]UM", "REFERENDUM"),
    ("[HMW][EF][HMW]B[EF]R", "MEMBER"), (r"\s[ODU0GC@][EF]\s", " OF "), (r"\s[TY1F]H[EF]\s", " THE "), ("[WHM]A[YV][ODU0GC@][RK]", "MAYOR"),
    ("SU[FP][EF][RK][YV][I1L!l|T]S[ODU0GC@][RK]", "SUPERVISOR"),
]
SHORT_WORDS = [("[WN][ODU0GCAo]", "NO"), ("[YV][EFeo][sS]", "YES")]


def summary_words(c: Column, rules: list[tuple[str, str]] = SUMMARY_WORDS) -> Column:
    """Misread words put right; a job may bring rules of its own."""
    c = folded(c, rules)
    return F.when(F.length(c) <= 4, folded(c, SHORT_WORDS)).otherwise(c)


# Misread words in mixed case, after those of SUMMARY_WORDS, in
# the order in which they are put right, and what they are made.
MIXED_WORDS = [
    (r"[WN][ODU0GC@]\sS[EF][L\\!][EF]C[TY1F][I1L!l|T][ODU0GC@][WN]\s[WHM]A[D0OB]EF]", "NO SELECTION MADE"), (r"\b[KR]epresentative\b", "Representative"), (r"\bGove(m|rn)m?or\b", "Governor"), (r"\bGove(m|rn)men[tk]\b", "Government"), (r"\bgove(m|rn)or\b", "governor"),
    (r"\bCh[il][eco][tf]\b", "Chief"), (r"\bA[isrxy]s?[tf]ic[1ltif][ea]\b", "Article"), (r"\ba[sr]tic[1lti]e\b", "article"), (r"\bArticle [iIl!1]", "Article I"), (r"\bArticle [iIl!1][iIl!1]", "Article II"), (r"\bArticle [iIl!1][iIl!1][iIl!1]", "Article III"), (r"\bArticle [iIl!1]V", "Article IV"),
    (r"\bArticle V[iIl!1]", "Article VI"), (r"\bArticle V[iIl!1][iIl!1]", "Article VII"), (r"\bArticle V[iIl!1][iIl!1][iIl!1]", "Article VIII"), (r"\bArticle [iIl!1]X", "Article IX"), (r"\bArticle X[iIl!1]", "Article XI"), (r"\bArticle X[iIl!1][iIl!1]", "Article XII"), (r"\bArticle X[iIl!1][iIl!1][iIl!1]\b", "Article XIII"),
    (r"\bA[pno][pno]rova[li1]\b", "Approval"), (r"\b[GC]o[mn]mi[lt][lt]?[esa][esao]\b", "Committee"), (r"L[il]eutenant", "Lieutenant"), (r"\bCourtofAppea[lt]\b", "Court of Appeal"), (r"\bAppee?a[tl]\b", "Appeal"), (r"\bAtto(rn|m)[eo][vy]\b", "Attorney"), (r"\bG?C[aoO]n[sS]t[i]?t[u]?[t]?ic?ona[iIl!l]?\b", "Constitutional"),
    (r"\bAnuse\b", "Abuse"), (r"\bA[jM]?m[oae][hna][dago]me[nmr][try]r?\b", "Amendment"), (r"\b[GCV]ons(tin|uru)tio[mn]al\b", "Constitutional"), (r"\b[WV][eo]t[ea]f[oa]rOn[eas]\b", "Vote for One"), (r"\b[lti1]egis[lti1]ature\b", "legislature"), (r"\bAg([tr]i|n)cu[flit]?[tl]ure\b", "Agriculture"), (r"\bCiti[rze][ea]n", "Citizen"),
    (r"\bDe[lft]en[cdt]i?er\b", "Defender"), (r"\bDi[sa]tr?[li]ct\b", "District"), (r"\bEnc[li]osed\b", "Enclosed"), (r"\bEstab[il]?[il]shes\b", "Establishes"), (r"\bEt[hfmn]?ic[sae]\b", "Ethics"), (r"\bFinanc[hit]a[li]?\b", "Financial"), (r"\b[FP]ropose[da]/b", "Proposed"), (r"\bGen[ce]ra[ilrt]\b", "General"),
    (r"\b[DG]epar[ti]ment\b", "Department"), (r"\b[DG]i?scriminatory\b", "Disciminatory"), (r"\b[BG]oard\b", "Board"), (r"\bJu[da]g[eao]\b", "Judge"), (r"\bJui?di[ca][ilt][ae][litf]\b", "Judicial"), (r"\bJus?tic[oe]\b", "Justice"), (r"\b[KR]evi[zsg][it]o[nr]\b", "Revision"), (r"\bLo[Dbo]b?[op]ying\b", "Lobbying"),
    (r"\bLoca[il]\b", "Local"), (r"\bO[fl][fl][li]cers?\b", "Officer"), (r"\bProhib[is]ts\b", "Prohibits"), (r"\bPub[li][li][ce]\b", "Public"), (r"\b[QC]harter\b", "Charter"), (r"\bQua[il]ifying\b", "Qualifying"), (r"\bRemova[il]\b", "Removal"), (r"\bR[ea]view\b", "Review"), (r"\bR[eo]pr[oe]s[eo][nf]tf?ativ[oe]s?\b", "Representative"),
    (r"\bRe[yv][ti][sagc][it]on\b", "Revision"), (r"\bS[ea][acosq]t[il[oaqp][eng]\b", "Section"), (r"\bSchoo[il]\b", "School"), (r"\bSha[ilf][ilf]\b", "Shall"), (r"\bS[it]ates\b", "States"), (r"\bautho(n|ri)za([ti]i|[5f])on\b", "authorization"), (r"\bbounda(n|ri)es\b", "boundaries"), (r"\bc(n|r)?im(m|in)i?(d|al)\b", "criminal"),
    (r"\b(ck|di)scrimina[ti]ory\b", "discriminatory"), (r"\bcompe[mn]sa([if]|[it])ion\b", "compensation"), (r"\bcounterterror?(ri|n)sm\b", "counterterrorism"), (r"\bde[ops][ea]r[it]ment\b", "department"), (r"\be[fl]i?minate", "eliminate"), (r"\b[ae]pproval\b", "approval"), (r"\b[ae]pproved\b", "approved"),
    (r"\b[tl]an[gq]ua[qg]e\b", "language"), (r"\b[tl]egis[ilt]ature\b", "legislature"), (r"\b[tl]egis[ilt]atures\b", "legislatures"), (r"\b[tl]eg[ij]s[li]ative\b", "legislative"), (r"\bma[nm]d[az]ti?ory\b", "mandatory"), (r"\bordi[nm]ance", "ordimance"), (r"\bpe[nm]a[li]it?ies\b", "penalities"), (r"\bpermanen[ti]ly\b", "permanenily"),
    (r"\bposi[fti]?i?on\b", "posifion"), (r"\bprosecu[tf]{0,2}ion\b", "prosecution"), (r"\bpro[vw]ides\b", "provides"), (r"\bre[lf]ated\b", "related"), (r"\bremo[vw]es\b", "removes"), (r"\brest(n|r[ti])c[ti][ti]ons\b", "restrictions"), (r"\brest(n|r[ti])ct?[if]ve\b", "restrictive"), (r"\brest(n|ri)i?ctions\b", "restrictions"),
    (r"\bre[lt]a[lt]ed\b", "related"), (r"\b[fr]inancial\b", "financial"), (r"\b[pr]roposed\b", "proposed"), (r"\bschoo[li]\b", "schooi"), (r"\bsecu[rt][li]ty\b", "security"), (r"\bs[tiu]r?uct[iu]re\b", "structure"), (r"\b[Ss]tepnanie\b", "Stephanie"), (r"\bsupe[nr]maj[ao](ri|n|mi)[lt]y\b", "supermajority"),
    (r"\bte(m|rr)i[it]or?[ni]?al\b", "territorial"), (r"\b[tr]ev[ri]s[ri]on\b", "revision"), (r"\bvapor-genera[tfif]{0,3}ng\b", ""), (r"\bva[tp]e\b", "vape"), (r"\b[vw]oter", "voter"), (r"\b[wj]?udicial\b", "judicial"), (r"\(tm\)", '"'),
]
NAME_WORDS = [("Nufiez", "Nuniez"), (r"\(tm\)", '"')]


def mixed_words(c: Column, names: bool = False) -> Column:
    """Misread words of a line in mixed case put right, or misread names."""
    if names:
        return folded(c, NAME_WORDS)
    return folded(F.trim(c), SUMMARY_WORDS + [(p.replace("t[il[oaqp]", "t[il\\[oaqp]"), to) for p, to in MIXED_WORDS])


def summary_line(c: Column) -> Column:
    """A line of a printed summary: upper case, without trailing plus signs,
    look-alike signs as letters, words put right, most punctuation dropped."""
    c = F.trim(F.regexp_replace(F.upper(c), r"\s*[{+>]+$", ""))
    c = folded(c, [("[\u00a2\u00a9\u0080\u20ac]", "C"), ("[\u00c9\u00e9]", "E"), ("\u201c", "I"), ("\u00a5", "V"), ("\u00a3", "L")])
    return F.regexp_replace(summary_words(c), r"[*\-_,~{}+<>=\"|\u20140\u201d\u2019;]", "")


def odd_character(c: Column) -> Column:
    """struct(char, code) of the first character that a summary line should
    not have; nulls if there is none."""
    found = F.nullif(F.regexp_extract(c, r"([^A-Z0-9()\s/:.])", 1), F.lit(""))
    return F.struct(found.alias("char"), F.lower(F.hex(F.ascii(found))).alias("code"))


def plain(c: Column) -> Column:
    """Latin letters without marks and plain quotes and dashes."""
    letters, bare = "".join(_BARE), "".join(_BARE.values())
    return folded(F.translate(c, letters, bare), [("ß", "ss"), ("[æ]", "ae"), ("[Æ]", "AE"), ("[œ]", "oe"), ("[Œ]", "OE"), ("…", "...")])


def _bare() -> dict[str, str]:
    import unicodedata

    found = {chr(i): unicodedata.normalize("NFKD", chr(i))[0] for i in range(0xC0, 0x250) if unicodedata.decomposition(chr(i)) and unicodedata.normalize("NFKD", chr(i))[0].isascii()}
    return found | dict(zip("‘’‚“”„–—−\u00a0", "''," + '"""' + "--- ", strict=True))


_BARE = _bare()


def without_target(c: Column) -> Column:
    """The text after a voting target that was read as one character."""
    return F.regexp_replace(c, r"^\S\s", "")


def shortened(c: Column, n: int) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def positions(c: Column, sub: str) -> Column:
    """Offsets from 0 of a substring, none overlapping the one before."""
    parts = F.split(c, F.lit("\\Q" + sub + "\\E"))
    ends = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)) + i * len(sub))
    return F.slice(ends, F.lit(1), F.size(parts) - 1)


def coordinate(c: Column) -> Column:
    """A coordinate string without quotes; a lost leading zero put back."""
    c = F.regexp_replace(c.cast("string"), "^'|'$", "")
    return F.when(F.length(c) < 6, F.concat(F.lit("0"), c)).otherwise(c)


def keep_region(c: Column) -> Column:
    """Whether a region's text is more than a stray mark."""
    return (F.length(c) >= 4) | F.lower(c).isin("yes", "no")


def flag(c: Column, default: bool = False) -> Column:
    """Yes, true, y, t, 1 and their opposites; blank is the default, other
    words are null."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x == "", F.lit(default)).when(x.isin("yes", "true", "t", "y", "1"), True).when(x.isin("no", "false", "f", "n", "0"), False)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edits / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """(len a + len b - indel distance) / (len a + len b), the distance being
    insertions and deletions only; batches come by Arrow."""

    from .fuzzy import ratio

    def one(x, y):
        return None if x is None or y is None else ratio(x, y)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
