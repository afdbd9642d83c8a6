"""Word segmentation by ICU, as JVM functions over columns.

Spark ships ICU and a Java compiler, so the few lines of Java below become a class when a session first needs them; its jar
is given to the executors in the ordinary way. Text is put in lower case and its compatibility forms are folded (NFKC),
which holds for documents, titles, slugs and queries alike. Chinese and Japanese words come from ICU's dictionary.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import STOP_WORDS

_STOPS = ", ".join(f'"{w}"' for w in STOP_WORDS)
_FOLD = "com.ibm.icu.text.Normalizer2.getNFKCInstance().normalize(((String) text).toLowerCase(java.util.Locale.ROOT))"
_SOURCES = {
    "Fold": f"""
package fernlight;
public final class Fold implements org.apache.spark.sql.api.java.UDF1 {{
    public Object call(Object text) {{
        return text == null ? null : {_FOLD};
    }}
}}
""",
    "Terms": f"""
package fernlight;
public final class Terms implements org.apache.spark.sql.api.java.UDF1 {{
    private static final java.util.Set STOPS = new java.util.HashSet(java.util.Arrays.asList(new Object[] {{{_STOPS}}}));

    private static boolean inner(int c) {{
        int kind = Character.getType(c);
        return Character.isLetter(c) || kind == Character.DECIMAL_DIGIT_NUMBER || kind == Character.LETTER_NUMBER || kind == Character.OTHER_NUMBER;
    }}

    public Object call(Object text) {{
        java.util.ArrayList out = new java.util.ArrayList();
        if (text != null) {{
            String all = {_FOLD};
            com.ibm.icu.text.BreakIterator words = com.ibm.icu.text.BreakIterator.getWordInstance(com.ibm.icu.util.ULocale.CHINESE);
            words.setText(all);
            int from = words.first();
            for (int to = words.next(); to != com.ibm.icu.text.BreakIterator.DONE; to = words.next()) {{
                int a = from;
                int b = to;
                from = to;
                while (a < b && !inner(all.codePointAt(a))) a += Character.charCount(all.codePointAt(a));
                while (a < b && !inner(all.codePointBefore(b))) b -= Character.charCount(all.codePointBefore(b));
                if (a == b) continue;
                String term = all.substring(a, b);
                int first = term.codePointAt(0);
                boolean oneHan = term.length() == Character.charCount(first) && Character.UnicodeScript.of(first) == Character.UnicodeScript.HAN;
                if (!oneHan && !STOPS.contains(term)) out.add(term);
            }}
        }}
        return out.toArray(new String[0]);
    }}
}}
""",
}
_NAMES = {"Fold": ("fernlight_fold", StringType()), "Terms": ("fernlight_terms", ArrayType(StringType()))}


def _jar(spark: SparkSession) -> str:
    """The compiled classes; one jar for each version of their source and each application."""
    jvm = spark._jvm
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fernlight-words-")), "fernlight-words.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for name, source in _SOURCES.items():
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
            compiler.cook(source)
            for entry in compiler.getBytecodes().entrySet():
                jar.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    return path


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, once."""
    if spark.catalog.functionExists("fernlight_terms"):
        return
    if not getattr(spark.sparkContext, "_fernlight_words", False):
        spark.sql(f"ADD JAR '{_jar(spark)}'")
        spark.sparkContext._fernlight_words = True
    session = spark._jsparkSession
    none = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 0)
    for name, (function, kind) in _NAMES.items():
        made = session.sharedState().jarClassLoader().loadClass(f"fernlight.{name}").getConstructors()[0].newInstance(none)
        session.udf().register(function, made, session.parseDataType(kind.json()))


def terms(c: Column) -> Column:
    """Terms with repetition: segmented, cleaned of what isn't letter or digit at their ends, without stop words and single
    Han characters. A null has none. The session must be registered."""
    return F.call_function("fernlight_terms", c)


def fold(c: Column) -> Column:
    """Lower case and compatibility forms folded."""
    return F.call_function("fernlight_fold", c)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct terms of a query in order, by the same function as those of documents."""
    register(spark)
    found = spark.range(1).select(F.array_distinct(terms(F.lit(query))).alias("t")).first()[0]
    return list(found)
