"""Text of HTML pages with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = "(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title)\\b[^>]*>"


def text_of(html: Column) -> Column:
    """Lines of visible text: no scripts, styles, comments or tags; block tags end a line."""
    x = F.regexp_replace(html, "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(F.regexp_replace(x, _BLOCK, "\n"), "<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), "\\s*\\n\\s*", "\n")
