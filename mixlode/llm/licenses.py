"""Licence scans by canonical digests, with built-in functions only.

A text's canonical form has ASCII lower case, no lines that are copyright notices, one spelling of
words that are spelled differently, and single spaces for all ASCII punctuation
and white space.  Its digest is looked up among those of known licence texts,
brought to the same form; the whole text must be the licence.

Defined cases: null text has a null digest and no licence; a text of nothing but
punctuation or copyright lines has the digest of the empty text and no licence;
repeated rows give repeated results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and notices, and spellings that count as equal.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
)
LICENCES: dict[str, list[str]] = {
    "MIT": [_MIT + _AS_IS, "MIT License\n\n" + _MIT + _AS_IS, "The MIT License (MIT)\n\n" + _MIT + _AS_IS, "Released under the MIT License."],
    "BSD-2-Clause": [_BSD + _BSD_END, "BSD 2-Clause License\n\n" + _BSD + _BSD_END],
    "BSD-3-Clause": [_BSD + _BSD_3 + _BSD_END, "BSD 3-Clause License\n\n" + _BSD + _BSD_3 + _BSD_END],
    "ISC": [_ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END, "ISC License\n\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END],
    "0BSD": [_ISC + "." + _ISC_END, "BSD Zero Clause License\n\n" + _ISC + "." + _ISC_END],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n'
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("http:", "https:"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("analogue", "analog"),
    ("behaviour", "behavior"), ("favour", "favor"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("&", "and"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), (" ", " "),
)
#: Canonical digests of full texts, of the copies in /usr/share/common-licenses; the second is of the text up to END OF TERMS AND CONDITIONS.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"],
    "BSD-3-Clause": ["21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2": ["1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"],
    "GFDL-1.3": ["7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"],
    "GPL-1.0": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"],
    "GPL-3.0": ["a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"],
    "LGPL-2.0": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"],
    "MPL-2.0": ["4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"],
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A notice: the word or sign, then a sign, a year, a placeholder or a name, up to the line's end.  A line that a wrap begins with
# "copyright holders" or an item "(c) You must" is none.
_YEAR, _NAME = r"(?:\(?\d{4}|[\[<{])", r"(?:[a-z0-9\"'@]|[^\x00-\x7F])"
_NOT_A_NAME = (
    r"(?!(?:notices?|holders?|owners?|ownership|licen[cs]es?|licensors?|statements?|laws?|acts?|interests?|protect(?:ion|ed|s)|rights?|disclaimers?|infringements?|claims?|works?|treaty|permissions?|terms?|lines?|headers?|doctrines?|representations|resulting|notwithstanding|the (?:software|library|program|works?|licen[cs]es?)|"
    r"and|or|in|on|of|to|for|from|is|are|as|at(?!&)|under|with|within|without|if|that|this|these|any|which|where|when|shall|must|(?:may|will) (?:be|not|have|apply)|does|can|has|have|it|its|not|no)\b)"
)
_CLAUSE = r"(?![^\n]*\b(?:must|shall|(?:may|will) (?:be|not|have|apply)|is|are|has|have|any|that|which|such|to|or(?! (?:its|their)\b))\b)"
_COPYRIGHT = (
    r"(^|\n)[ \t*#/;-]*(?:"
    rf"copyright(?![a-z])(?:[ \t:,.-]*+(?:\(c\)|©|{_YEAR})|[ \t:-]*+{_NOT_A_NAME}{_NAME})"
    rf"|\(c\)(?:[ \t:,.-]*+(?:copyright(?![a-z])|{_YEAR})|[ \t:-]*+{_NOT_A_NAME}{_CLAUSE}{_NAME})"
    r"|©|all rights reserved)[^\n]*"
)
_SQL_COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"  # the SQL is as it was: it takes any line that begins so
_BLANK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null for null."""
    t = F.regexp_replace(F.translate(text, _UPPER, _LOWER), _COPYRIGHT, "$1")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.trim(F.regexp_replace(t, _BLANK, " "))
    for a, b in SPELLINGS:
        if " " in a.strip():  # two words that a wrap had parted
            t = F.replace(t, F.lit(a), F.lit(b))
    return t


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scanned(docs: DataFrame, texts: dict[str, list[str]] = LICENCES, digests: dict[str, list[str]] = DIGESTS) -> DataFrame:
    """doc_id, digest of the canonical text, license_id (null: none of the known licences)."""
    rows = [(name, t) for name, forms in texts.items() for t in forms]
    known = docs.sparkSession.createDataFrame(rows, "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    full = docs.sparkSession.createDataFrame([(name, d) for name, forms in digests.items() for d in forms], "license_id string, digest string")
    known = known.unionByName(full).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    found = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return found.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id")  # as many rows as LICENCES and DIGESTS have forms


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and licence."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """The same for DuckDB, but for lines that begin with "copyright" or "(c)" and are no notices, which it drops."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), {quote(_SQL_COPYRIGHT)}, '\\1', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {quote(a)}, {quote(b)})"
    form = f"sha256(trim(regexp_replace({t}, {quote(_BLANK)}, ' ', 'g')))"
    values = ", ".join(f"({quote(name)}, {quote(x)})" for name, forms in LICENCES.items() for x in forms)
    return f"""WITH known AS (SELECT {form} AS digest, min(license_id) AS license_id FROM (VALUES {values}) AS v(license_id, text) GROUP BY 1),
    d AS (SELECT doc_id, {form} AS digest FROM documents) SELECT doc_id, d.digest AS digest, license_id FROM d LEFT JOIN known USING (digest)"""
