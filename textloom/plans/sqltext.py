"""SQL fragments shared by the DuckDB twins."""

# Characters that count as whitespace for word splitting.
WS = (
    r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def words(col: str) -> str:
    return f"regexp_extract_all({col}, '[^{WS}]+')"


def clean(col: str) -> str:
    return rf"trim(lower(regexp_replace({col}, '[^\p{{L}}\p{{N}}_{WS}]', '', 'g')), ' ')"


def squeeze(col: str) -> str:
    return rf"regexp_replace({col}, '[\t\n\x0b\f\r ]+', ' ', 'g')"


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Cleaned, de-duplicated documents: the corpus most text queries start from.
CLEAN_DOCS = f"""
  cleaned AS (
    SELECT doc_id, lang, text, {squeeze(clean('text'))} AS content_clean
    FROM documents WHERE length({clean('text')}) > 0
  )"""

# One row per word of a cleaned document: doc_id, pos (1-based), word.
CLEAN_TOKENS = CLEAN_DOCS + f""",
  toks AS (
    SELECT doc_id, lang, unnest({words('content_clean')}) AS word,
           generate_subscripts({words('content_clean')}, 1) AS pos
    FROM cleaned
  )"""
