"""SQL expressions for the oracles: the url split, written for DuckDB."""

SCHEME = r"'^([a-zA-Z][a-zA-Z0-9+.\-]*):'"
AUTHORITY = r"'^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)'"
PATH = r"'^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#;]*)'"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {SCHEME}, 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, {AUTHORITY}, 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, {PATH}, 1)"


def query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '^[^#]*#(.*)$', 1)"


def site(u: str) -> str:
    return f"concat({scheme(u)}, '://', {netloc(u)})"


def base(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def stem(name: str) -> str:
    return rf"regexp_replace({name}, '^(\.*[^.].*?)\.[^.]*$', '\1')"


def keep_key_params(u: str) -> str:
    kept = (f"list_filter(string_split({query(u)}, '&'), lambda x: lower(split_part(x, '=', 1)) IN "
            "('page','p','id','category','tag') AND split_part(x, '=', 2) <> '')")
    return (f"concat({site(u)}, {path(u)}, CASE WHEN len({kept}) > 0 AND {query(u)} <> '' "
            f"THEN concat('?', array_to_string({kept}, '&')) ELSE '' END)")


def html_path(p: str) -> str:
    return (rf"(regexp_matches(lower({p}), '\.(html|htm|php|asp|aspx|jsp)$') OR NOT contains({base(p)}, '.') "
            f"OR ends_with({p}, '/'))")


VISIBLE = r"regexp_replace(html, '<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'gs')"

# every anchor of the given pages has one attribute, href, and plain text
ANCHORS = f"""anchors AS (
  SELECT page_id, url AS page_url, pos - 1 AS pos, decoded[1] AS href, trim(decoded[2]) AS text,
         concat({site('url')}, decoded[1]) AS link
  FROM (SELECT page_id, url, pos, [replace(replace(h, '&quot;', '"'), '&amp;', '&'),
                                   replace(replace(t, '&quot;', '"'), '&amp;', '&')] AS decoded
        FROM (SELECT page_id, url, unnest(regexp_extract_all(v, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h,
                     unnest(regexp_extract_all(v, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t,
                     generate_subscripts(regexp_extract_all(v, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos
              FROM (SELECT page_id, url, {VISIBLE} AS v FROM pages)))
  WHERE trim(decoded[1]) <> '' AND NOT starts_with(trim(decoded[1]), '#'))"""
