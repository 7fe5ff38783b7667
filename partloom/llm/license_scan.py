"""Licence scans by canonical digest lookup: normalise, hash, and join whole texts to the digests of known licences."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, table

# Public licence texts and the usual one-line notices.
KNOWN: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
}
# Spellings that licence matching holds equal, applied in this order to space-bounded words.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("recognise", "recognize"),
    ("https", "http"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
]
# Title lines that published texts carry above their licence, in canonical form.
TITLES = [
    "mit license", "the mit license", "the mit license mit", "isc license", "the isc license", "bsd 2 clause license", "bsd 3 clause license",
    "the bsd 2 clause license", "the bsd 3 clause license", "the 2 clause bsd license", "the 3 clause bsd license", "simplified bsd license", "new bsd license", "zlib license", "the zlib license", "the unlicense",
]
# Digests of the canonical form of longer public licence texts.
KNOWN_DIGESTS: dict[str, str] = {
    "Apache-2.0": "8f86909a6dbf3a124c7a7d11b3aaf31f",
    "Artistic-1.0-Perl": "a8b0fb0c6e43a3b36bdc159e59dbfd1e",
    "CC0-1.0": "d2a76f70ce19809695b7fb93c6241c23",
    "GFDL-1.2": "7a0a547ecac612b526676be523eacf80",
    "GFDL-1.3": "7132e8380bc59358f27c3129a2136bf1",
    "GPL-1.0": "738cc3b112640d95d4cd79a58967ecea",
    "GPL-2.0": "5e39ace6e62f5a7fe9c17b4da986ad8c",
    "GPL-3.0": "b79359b5e391fd47146ff34ae3db7ec0",
    "LGPL-2.0": "74cf7fcef3b29a39165a795b2cad3a3a",
    "LGPL-2.1": "f998bc436710cfece156aaa84fd26dd4",
    "LGPL-3.0": "b31b7335bc37919e8cdd79154e04d88d",
    "MPL-1.1": "9fa8ae3e869a929215034d82982372b5",
    "MPL-2.0": "b5b7a0cf4994910cd0204fba4637d6ec",
}
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|[:<\[{]|[ \t](?:[a-z]\.|by[ \t]|the[ \t]))|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _spelled(t: Column, spellings: list[tuple[str, str]]) -> Column:
    """Words of `t`, which two spaces part and one space bounds, in their one spelling."""
    for old, new in spellings:
        t = F.replace(t, F.lit(" " + old.replace(" ", "  ") + " "), F.lit(" " + new.replace(" ", "  ") + " "))
    return t


def canonical_lines(text: Column) -> Column:
    """Non-empty lines of the text, lower case, without copyright lines, spellings made one; two spaces part the words,
    so that equal neighbours do not share one."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, NOT_WORD, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    return F.filter(F.transform(F.split(_spelled(t, SPELLINGS), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _plain(line: Column) -> Column:
    return F.replace(line, F.lit("  "), F.lit(" "))


def canonical_whole(lines: Column) -> Column:
    """The lines that are no licence's title as one line, with the spellings that span a line end made one."""
    kept = F.filter(lines, lambda x: ~_plain(x).isin(TITLES))
    return _plain(F.trim(_spelled(F.concat(F.lit(" "), F.array_join(kept, "  "), F.lit(" ")), [s for s in SPELLINGS if " " in s[0]])))


def canonical_text(text: str) -> str:
    """`canonical_whole` on one string, for the table of known digests."""

    def spelled(t: str, spellings) -> str:
        for old, new in spellings:
            t = t.replace(" " + old.replace(" ", "  ") + " ", " " + new.replace(" ", "  ") + " ")
        return t

    t = re.sub(COPYRIGHT_LINE.replace(r"\p{L}\p{N}", r"\w"), "", text.lower())
    t = " " + re.sub(r"(?:[^\w\n]|_)+", "  ", t).replace("\n", " \n ") + " "
    lines = [x for x in (y.strip(" ") for y in spelled(t, SPELLINGS).split("\n")) if x and x.replace("  ", " ") not in TITLES]
    return spelled(" " + "  ".join(lines) + " ", [s for s in SPELLINGS if " " in s[0]]).strip(" ").replace("  ", " ")


def digest_of(text: str) -> str:
    return hashlib.md5(canonical_text(text).encode()).hexdigest()


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """Digests of the texts `known` or, by default, of `KNOWN` together with `KNOWN_DIGESTS`."""
    rows = {(digest_of(t), n) for n, t in (KNOWN if known is None else known).items()}
    rows |= {(d, n) for n, d in KNOWN_DIGESTS.items()} if known is None else set()
    return spark.createDataFrame(sorted(rows), "known_digest string, license_id string").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 10_000) -> DataFrame:
    """Which known licence each whole text is, and which of its lines are one.

    `known(known_digest, license_id)` is broadcast while it has at most `broadcast_rows` rows, else hash-joined by a
    shuffle. Texts are made canonical once: their digests and those of their lines are written, and the joins read
    them. Returns one row per input row: `id_col, digest, license_id, n_notices, notices`. digest: md5 of the canonical
    whole text, in which line ends and licence titles do not count. license_id: the licence whose canonical text has
    that digest, else null. notices: sorted, distinct licences that single lines match; n_notices: number of such
    lines.

    Null and empty texts, and texts of punctuation, titles or copyright lines only, have the digest of the empty text
    and match nothing. Repeated rows give repeated rows. Empty table: no rows. Other columns are ignored.
    """
    side = F.broadcast(known) if known.limit(broadcast_rows + 1).count() <= broadcast_rows else known
    # An outer generator makes the lines once; without it each use of them would make them again.
    lines = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.array(canonical_lines(F.coalesce(F.col(text_col), F.lit(""))))).alias("lines"))
    one = F.transform("lines", lambda x: F.md5(F.encode(_plain(x), "UTF-8")))
    seen = lines.select("id", F.md5(F.encode(canonical_whole(F.col("lines")), "UTF-8")).alias("digest"), one.alias("own"), F.monotonically_increasing_id().alias("r"))
    seen = Scratch(docs.sparkSession).cut(seen)
    hits = seen.select("r", F.explode_outer("own").alias("known_digest")).join(side, "known_digest").groupBy("r").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("license_id")).alias("notices"))
    base = seen.select("id", "digest", "r").join(side, F.col("digest") == F.col("known_digest"), "left")
    return base.join(hits, "r", "left").select(
        F.col("id").alias(id_col),
        "digest",
        "license_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )


def op5_license_scan(spark, sf_dir) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))
    return out.select("doc_id", "digest", "license_id", "n_notices", F.array_join("notices", ",").alias("notices"))


def _oracle() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def spelled(t: str, spellings) -> str:
        for old, new in spellings:
            t = f"replace({t}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
        return t

    t = f"concat(' ', replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), {q(COPYRIGHT_LINE)}, '', 'g'), {q(NOT_WORD)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' '), ' ')"
    lines = f"list_filter(list_transform(string_split({spelled(t, SPELLINGS)}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    own = f"list_filter(ls, lambda x: replace(x, '  ', ' ') not in ({', '.join(q(x) for x in TITLES)}))"
    whole = f"replace(trim({spelled(f"concat(' ', array_to_string({own}, '  '), ' ')", [x for x in SPELLINGS if ' ' in x[0]])}, ' '), '  ', ' ')"
    known = [*((digest_of(x), n) for n, x in KNOWN.items()), *((d, n) for n, d in KNOWN_DIGESTS.items())]
    values = ", ".join(f"({q(d)}, {q(n)})" for d, n in known)
    return f"""
    with known as (select d, min(n) as n from (values {values}) k(d, n) group by d),
    lines as (select row_number() over () as r, doc_id, {lines} as ls from documents),
    whole as (select r, doc_id, ls, md5({whole}) as digest from lines),
    hits as (select r, count(*) as c, string_agg(distinct n, ',' order by n) as names
             from (select r, unnest(list_transform(ls, lambda x: md5(replace(x, '  ', ' ')))) as d from whole) join known using (d) group by r)
    select doc_id, digest, known.n as license_id, coalesce(c, 0)::bigint as n_notices, coalesce(names, '') as notices
    from whole left join known on digest = known.d left join hits using (r)
    """


ORACLE = _oracle()
