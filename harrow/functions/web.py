"""Addresses, mailboxes, numbers, countries and job titles, as Column expressions."""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.text import END, START, _c, clean, fold, text

# Sites that are never a company's own.
NOT_COMPANY = r"(?i)(^|\.)(linkedin|facebook|instagram|twitter|x|xing|youtube|tiktok|pinterest|wikipedia|amazon|northdata|kompass|dnb|crunchbase|zoominfo|glassdoor|indeed|yelp|google|bing|duckduckgo|buchmesse|expoplatform|cloudfront|goodreads|apple|medium|github|bold|firmenwissen|wlw|europages|gelbeseiten|dasoertliche|handelsregister|unternehmensregister|opencorporates|trustpilot|bookwire)\."
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+|00)\d[\d\s()./-]{7,17}\d|\(?0\d{2,5}\)?[\s/.-]?\d[\d\s/.-]{5,12}\d"
# Mailboxes of no one person.
GENERIC_MAIL = r"(?i)^(info|infos?|kontakt|contact|contacts|office|mail|email|sales|hello|hallo|hi|service|support|verlag|team|post|redaktion|presse|press|vertrieb|buchhaltung|rechnung|bestellung|order|orders|admin|webmaster|datenschutz|privacy|jobs|karriere|career|careers|marketing|rights|foreignrights|licensing|lizenzen|editorial|submissions|manuscripts|manuskripte|lektorat|accounts|billing|invoice|newsletter|shop|store|events|accueil|commercial|commandes|direction|redaction|rédaction|secretariat|editions|librairie|ventas|pedidos|administracion|comercial|vendite|amministrazione|segreteria|ordini|redazione|commerciale|biuro|sekretariat|handlowy|zamowienia|wydawnictwo|redakcja|verkoop|bestellingen|uitgeverij|noreply|no-reply)$"


def host_of(url) -> Column:
    """Lower-case host of an http address, without port or user; null if there is none."""
    h = F.regexp_extract(_c(url), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(h != "", F.lower(h))


def path_of(url) -> Column:
    return F.regexp_extract(_c(url), r"(?i)^https?://[^/?#]*([^?#]*)", 1)


def bare_host(url) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def base_domain(host) -> Column:
    """The registered part of a host, for the compound endings in use."""
    parts = F.split(F.regexp_replace(F.lower(_c(host)), r"^www\.", ""), r"\.")
    compound = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").rlike(r"^(co|com|org|net|ac|gov)\.[a-z]{2}$")
    n = F.when(compound, 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")


def clean_website(raw, fair_host: str | None = None) -> Column:
    """Origin and path of a company's site; null for what is no address, or on a site of many companies or the fair's own."""
    t = F.trim(text(raw))
    with_scheme = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^//", "")))
    host = host_of(with_scheme)
    port = F.regexp_extract(with_scheme, r"(?i)^https?://[^/?#:]*(:[0-9]+)", 1)
    ok = (t != "") & ~t.rlike(r"\s") & host.contains(".") & ~F.concat(host, F.lit(".")).rlike(NOT_COMPANY)
    if fair_host:
        ok = ok & (base_domain(host) != base_domain(F.lit(fair_host)))
    return F.when(ok, F.concat(F.lower(F.regexp_extract(with_scheme, "(?i)^(https?)", 1)), F.lit("://"), host, port, F.regexp_replace(path_of(with_scheme), "/$", "")))


def clean_linkedin(href) -> Column:
    pattern = r"(?i)^(?:https?:)?//(?:[a-z]{2,3}\.|www\.)?linkedin\.com/(in|company|school|showcase)/([^/?#\s]+)"
    kind = F.regexp_extract(_c(href), pattern, 1)
    return F.when(kind != "", F.concat(F.lit("https://www.linkedin.com/"), F.lower(kind), F.lit("/"), F.regexp_extract(_c(href), pattern, 2)))


def same_site(a, b) -> Column:
    """Whether one host is the other or below it."""
    x, y = bare_host(a), bare_host(b)
    return F.coalesce((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)), F.lit(False))


def directory_path(url) -> Column:
    """Host and path without a language or an ending slash, to tell pages apart."""
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?i)^/(de|en|fr|es|it)(/|$)", "/"), "/+$", "")
    return F.concat(F.coalesce(host_of(url), F.lit("")), path)


def encode_component(c) -> Column:
    """A value as part of an address, slashes kept."""
    e = F.replace(F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(char))
    return e


def fill_pattern(pattern: str, value) -> Column:
    """The address of a row by a pattern with {v}; a pattern of {v} alone takes whole addresses."""
    v = text(value)
    if pattern == "{v}":
        return F.when(v.rlike("(?i)^https?://"), v).otherwise("")
    before, _, after = pattern.partition("{v}")
    return F.when(v == "", "").otherwise(F.concat(F.lit(before), encode_component(v), F.lit(after)))


def pattern_from(href, value) -> Column:
    """The pattern that makes href of value: its last place there, as a whole part of the path or query; else null."""
    h, v = _c(href), text(value)

    def at(form: Column) -> Column:
        i = F.length(h) - F.instr(F.reverse(h), F.reverse(form)) - F.length(form) + 2  # 1-based start of the last occurrence
        before, after = F.substring(h, i - 1, F.lit(1)), F.substring(h, i + F.length(form), F.lit(1))
        whole = before.isin("/", "=") & after.isin("", "/", "?", "#", "&") & (i > 1)
        return F.when((F.instr(h, form) > 0) & whole, F.concat(F.substring(h, F.lit(1), i - 1), F.lit("{v}"), F.substring(h, i + F.length(form), F.length(h))))

    sluggish = v.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}._~%-]{1,150}$")
    return F.when(sluggish, F.coalesce(at(v), at(F.replace(encode_component(v), F.lit("/"), F.lit("%2F")))))


def emails_in(c) -> Column:
    return F.regexp_extract_all(text(c), F.lit(EMAIL), F.lit(0))


def tidy_phone(c) -> Column:
    t = clean(c)
    opens, closes = F.regexp_count(t, F.lit(r"\(")), F.regexp_count(t, F.lit(r"\)"))
    t = F.when(closes > opens, F.regexp_replace(t, r"^([+\d]+)\)", "$1")).when(opens > closes, F.regexp_replace(F.regexp_replace(t, r"\($", ""), r"^\(", "")).otherwise(t)
    return F.trim(t)


def phones_in(c) -> Column:
    tidy = F.transform(F.regexp_extract_all(text(c), F.lit(PHONE), F.lit(0)), tidy_phone)
    return F.filter(tidy, lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(8, 15))


def is_generic_mailbox(email) -> Column:
    return F.split(text(email), "@")[0].rlike(GENERIC_MAIL)


TITLES = r"(?i)^(?:dr\.?|prof\.?|mag\.?|dipl\.?(?:-\w+\.?)?|ing\.?|mr\.?|mrs\.?|ms\.?|herr|frau)$"


def email_belongs_to(email, name) -> Column:
    """Whether an address has the person's last name in it, of three letters or more."""
    local = F.regexp_replace(fold(F.split(text(email), "@")[0]), "[^a-z]", "")
    parts = F.filter(F.split(fold(text(name)), " "), lambda w: (F.length(w) > 1) & ~w.rlike(TITLES))
    last = F.regexp_replace(F.get(parts, F.size(parts) - 1), "[^a-z]", "")
    return F.coalesce((F.length(last) >= 3) & local.contains(last), F.lit(False))


def appears_in(whole, value) -> Column:
    return fold(text(whole)).contains(fold(text(value)))


def sites_in(c, most: int = 3) -> Column:
    """The first so many sites of different hosts that a text names."""
    found = F.transform(F.regexp_extract_all(text(c), F.lit(r"https?://[^\s<>()\"'\]\[【】]+"), F.lit(0)), lambda u: clean_website(F.regexp_replace(u, r"[.,;:!?]+$", "")))
    origins = F.transform(F.filter(found, lambda u: u.isNotNull()), lambda u: F.regexp_extract(u, "^https?://[^/]+", 0))
    hosts = lambda a: F.transform(a, lambda u: F.regexp_replace(u, "^https?://", ""))
    return F.slice(F.filter(origins, lambda u, i: F.array_position(hosts(origins), F.regexp_replace(u, "^https?://", "")) == i + 1), 1, most)


# Country names as fairs write them, and the usual ending of their sites.
COUNTRIES = [
    ("deutschland|germany", ".de"), ("[öo]sterreich|austria", ".at"), ("schweiz|switzerland|suisse|svizzera", ".ch"), ("frankreich|france", ".fr"), ("italien|italy|italia", ".it"),
    ("spanien|spain|espa[ñn]a", ".es"), ("polen|poland|polska", ".pl"), ("niederlande|netherlands|nederland", ".nl"), ("belgien|belgium|belgique", ".be"),
    ("vereinigtes k[öo]nigreich|united kingdom|uk|gro[ßs]britannien|england|schottland|scotland", ".co.uk"), ("vereinigte staaten|united states|usa|us", ".com"), ("portugal", ".pt"),
    ("tschechien|czech republic|czechia", ".cz"), ("d[äa]nemark|denmark", ".dk"), ("schweden|sweden", ".se"), ("norwegen|norway", ".no"), ("finnland|finland", ".fi"), ("ungarn|hungary", ".hu"),
    ("griechenland|greece", ".gr"), ("irland|ireland", ".ie"), ("luxemburg|luxembourg", ".lu"), ("rum[äa]nien|romania", ".ro"), ("kroatien|croatia", ".hr"), ("slowenien|slovenia", ".si"),
    ("slowakei|slovakia", ".sk"), ("litauen|lithuania", ".lt"), ("lettland|latvia", ".lv"), ("estland|estonia", ".ee"), ("bulgarien|bulgaria", ".bg"), ("serbien|serbia", ".rs"), ("ukraine", ".ua"),
    ("kanada|canada", ".ca"), ("australien|australia", ".com.au"), ("neuseeland|new zealand", ".co.nz"), ("japan", ".co.jp"), ("republik korea|s[üu]dkorea|south korea|korea", ".co.kr"),
    ("indien|india", ".in"), ("brasilien|brazil", ".com.br"), ("mexiko|mexico", ".com.mx"), ("argentinien|argentina", ".com.ar"), ("t[üu]rkei|turkey|t[üu]rkiye", ".com.tr"), ("israel", ".co.il"),
    ("singapur|singapore", ".com.sg"), ("taiwan", ".com.tw"), ("s[üu]dafrika|south africa", ".co.za"), ("china|volksrepublik china", ".cn"),
]
# Adjectives of countries.
ADJECTIVES = {
    "german": "deutschland", "deutsche": "deutschland", "deutschen": "deutschland", "french": "frankreich", "französische": "frankreich", "italian": "italien", "italienische": "italien",
    "spanish": "spanien", "british": "united kingdom", "english": "united kingdom", "american": "united states", "austrian": "österreich", "swiss": "schweiz", "dutch": "niederlande",
    "polish": "polen", "belgian": "belgien", "portuguese": "portugal", "czech": "tschechien", "danish": "dänemark", "swedish": "schweden", "norwegian": "norwegen", "finnish": "finnland",
    "korean": "republik korea", "japanese": "japan", "chinese": "china", "indian": "indien", "canadian": "kanada",
}


def country_tld(country) -> Column:
    c, out = F.lower(F.trim(text(country))), None
    for names, tld in COUNTRIES:
        hit = c.rlike(f"^({names})$")
        out = F.when(hit, tld) if out is None else out.when(hit, tld)
    return out


def same_country(country, asked: str) -> Column:
    """Whether a row's country is the one asked for, by any of its names; asked is resolved when the plan is made."""
    import re

    name = re.sub("^the ", "", asked.strip().lower())
    name = ADJECTIVES.get(name, name)
    names = next((n for n, _ in COUNTRIES if re.fullmatch(n, name)), None)
    c = F.lower(F.trim(text(country)))
    return c.rlike(f"^({names})$") if names else c == asked.strip().lower()


# Job titles and the role they stand for; the first that matches counts.
ROLES = [
    ("purchasing", r"(einkauf\w*|purchas\w+|procurement|head of buying|buyer|rights\s*(?:&|and|und)\s*licens\w+|licens(?:e|ing) manager|lizenz\w*|rechte\w*|responsable des achats|achats|acheteur|acheteuse|acquisti|compras|zakup\w*)" + END),
    ("ceo", r"(ceo|chief executive|vorstandsvorsitzende[rn]?|gesch[aä]ftsf[uü]hrer(?:in)?|general manager|president|praesident|präsident(?:in)?|pdg|directeur g[ée]n[ée]ral|directrice g[ée]n[ée]rale|pr[ée]sident(?:e)?|amministratore delegato|amministratrice delegata|presidente|director general|directora general|consejer[oa] delegad[oa]|prezes|dyrektor generalny|algemeen directeur|legale rappresentante|repr[ée]sentant(?:e)? l[ée]gal(?:e)?|representante legal)(?!\p{L})"),
    ("owner", r"(inhaber(?:in)?|owner|founder|co-?founder|gr[uü]nder(?:in)?|eigent[uü]mer(?:in)?|proprietor|g[ée]rant(?:e)?|fondat(?:eur|rice|ore)|co-?fondat(?:eur|rice|ore)|propri[ée]taire|titolare|fundador(?:a)?|cofundador(?:a)?|propietari[oa]|eigenaar|oprichter|w[łl]a[śs]ciciel\w*|za[łl]o[żz]yciel\w*)(?!\p{L})"),
    ("md", r"(managing director|gesch[aä]ftsleitung|verlagsleit\w*|verleger(?:in)?|publisher|publishing director|director|vorstand|programmleit\w*|head of|directeur de (?:la )?publication|directrice de (?:la )?publication|directeur [ée]ditorial|directrice [ée]ditoriale|[ée]diteur|[ée]ditrice|direttore editoriale|direttrice editoriale|editore|direttore|direttrice|director editorial|directora editorial|uitgever|directeur|directrice|dyrektor\w*)(?!\p{L})"),
    ("decision", r"(editor[- ]in[- ]chief|chefredakt\w+|chief \w+ officer|cfo|coo|cto|cmo|cdo|leiter(?:in)?|leitung|vice president|vp|r[ée]dacteur en chef|r[ée]dactrice en chef|caporedattore|redattore capo|jefe de redacci[óo]n)(?!\p{L})"),
]
NOT_DECISION = r"(ip owner|product owner|rights owner|copyright owner|brand owner|account manager|assistant|assistent\w*|praktikant\w*|intern|trainee|volont\w*|werkstudent\w*|student)"


def is_excluded_title(title) -> Column:
    return text(title).rlike(f"(?iu){START}{NOT_DECISION}{END}")


def role_of(title) -> Column:
    """The role a title stands for. Most texts hold none, which one pass over their lower case says; case by Unicode, role by role, is looked at in the others only."""
    t, out = text(title), None
    for role, pattern in ROLES:
        hit = t.rlike(f"(?iu){_starts(pattern)}")
        out = F.when(hit, role) if out is None else out.when(hit, role)
    lower = F.lower(F.translate(t, "ſıİ", "sii"))  # letters that match others whatever the case, but aren't lower-cased to them
    return F.when(lower.rlike(_starts(_by_letter(tuple(pattern for _, pattern in ROLES)))), F.when(~is_excluded_title(t), out))


@functools.cache
def _by_letter(patterns: tuple[str, ...]) -> str:
    """The alternatives of patterns of the form (a|b|c) and an end, put under their first letters: where a word begins with none of them, some thirty letters are tried and not every alternative."""
    under: dict[str, list[str]] = {}
    for pattern in patterns:
        depth, marks = 0, [0]
        for i, x in enumerate(pattern):
            depth += (x in "([") - (x in ")]")
            if depth == 1 and x == "|" or depth == 0:
                marks.append(i)
            if depth == 0:
                break
        for a, b in itertools.pairwise(marks):
            first, rest = re.fullmatch(r"(\[[^\]]*\]|\w)(.*)", pattern[a + 1 : b]).groups()
            for letter in first.strip("[]"):
                under.setdefault(letter, []).append(rest + pattern[marks[-1] + 1 :])
    return "(?:" + "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in under.items()) + ")"


def _starts(pattern: str) -> str:
    """A word boundary before an ASCII word: titles that begin with another letter are found only inside one."""
    return rf"(?:{START}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))" + pattern


# Blocks of addresses that are not public.
PRIVATE = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def v4_number(ip) -> Column:
    parts = F.split(_c(ip), r"\.")
    return sum((parts[i].try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(1, 4)), parts[0].try_cast("bigint") * (1 << 24))


def is_private_ip(ip) -> Column:
    """Whether an address is not a public one; what is no address counts as private."""
    ip = text(ip)
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4, v6 = rf"^{octet}(\.{octet}){{3}}$", F.lower(ip)
    number = lambda x: sum(int(p) << 8 * (3 - i) for i, p in enumerate(x.split(".")))

    def blocked(c: Column) -> Column:
        n, out = v4_number(c), F.lit(False)
        for base, bits in PRIVATE:
            out = out | (F.shiftright(n, 32 - bits) == (number(base) >> (32 - bits)))
        return out

    mapped = F.regexp_extract(v6, r"^::ffff:([0-9]+(?:\.[0-9]+){3})$", 1)
    six = v6.isin("::", "::1") | F.when(mapped != "", F.when(mapped.rlike(v4), blocked(mapped)).otherwise(True)).otherwise(v6.rlike("^(fc|fd|fe8|fe9|fea|feb|ff)"))
    return F.when(ip.rlike(v4), blocked(ip)).when(v6.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$"), six).otherwise(True)
