"""License scans: canonical texts, digested and hash-joined to known license digests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

# Spellings that count as equal (the public matching guidelines for license texts), in lower case.
SPELLINGS = [("licence", "license"), ("https://", "http://"), ("©", "(c)"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("organisation", "organization"), ("programme", "program"), ("recognise", "recognize"), ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"), ("&", " and "), ("\r", " ")]
# The same for spellings of several words, which may lie on two lines: they are replaced in whole canonical texts.
PHRASES = [("copyright holder", "copyright owner"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense")]
# Words that follow "copyright" in a license's own sentences, where no holder is named.
PROSE = "act and as disclaimer doctrine for holder holders in infringement interest interests is laws law license licenses notice notices of or owner owners ownership permission protection right rights statement statements that the this to treaty".split()
WORD, NO_WORD = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\n]"
#: Lines that name a holder and not a license: "copyright" and a name, a year or a sign; "(c)" and a year; rights reserved.
HOLDER = rf"(?md)^{NO_WORD}*(?:copyright{NO_WORD}++(?={WORD})(?!(?:{'|'.join(PROSE)})(?:(?!{WORD})|$))[^\n]*|\(c\){NO_WORD}*[0-9]{{4}}[^\n]*|all rights reserved{NO_WORD}*)$"
#: Marks of list items before their item: at a line's start, or after the end of a sentence or clause where lines are joined.
#: A number elsewhere, as that of a version at a line's end, is no mark.
BULLET = rf"(?:^{NO_WORD}*|(?<=\p{{L}}{{4}}[.;:] )|(?<=[:;] ))\(?(?:[0-9]{{1,2}}|[a-z]|[ivx]{{2,4}})[.)]+(?:[ \t]+(?={NO_WORD}*{WORD})|(?<=[:;.] {{1,2}}\(?\w{{1,4}}[.)]{{1,2}})[ \t]*(?=\n))"
OTHER = rf"{NO_WORD}+"
# Lines that are a license's title, in their canonical spelling; they say no more than the text below them.
TITLES = ["mit license", "the mit license", "mit license mit", "the mit license mit", "mit", "isc license", "the isc license", "bsd license", "the bsd license", "new bsd license", "bsd 2 clause license", "bsd 3 clause license", "bsd 2 clause simplified license", "the 2 clause bsd license", "the 3 clause bsd license", "simplified bsd license"]

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
# Public license texts and the notices that stand for them, without holders.
KNOWN = [
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "This project is licensed under the MIT License."),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "Licensed under the GNU General Public License v3.0."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"), ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]


# SHA-256 of the canonical form (`digest_of`) of public license texts that are too long to write out here.
# Each whole, and up to its last terms where it has an appendix.
DIGESTS = [
    ("Apache-2.0", "f86c45fc72b043272de5d765793567a95363a0016be29aaee3c6a6d8b0ca5532"),
    ("Apache-2.0", "9666d051921bc497595d01b3c5b73b1f06842a6aa072b0221619c1e6d78d99e7"),
    ("Apache-2.0", "95ebafaabf80c10ce0c02d6506b3c942348da0561e2d2af910f930ef055bc343"),
    ("Artistic-1.0-Perl", "13caa6a0bc52f01d305d07b8139a4750d73ad358309326b68cc4acee2a5d977f"),
    ("CC0-1.0", "fc3b7547cd22a69f533f8dc61ce0b9bba032990bd8d72935ddd5cf7045643f54"),
    ("GFDL-1.2", "547516be957ae32fee766d10b189f587e8f2d09498906d42c05d5e2194cf2daa"),
    ("GFDL-1.3", "16b6e40aadeb1156523cc9f5b906bbe46eee9ef7f901168bb4b81f734621eff2"),
    ("GPL-1.0", "3e3168af67a1bdba104231c8b36efaf73e3a01fbd65c58857d49d871f8b6e343"),
    ("GPL-1.0", "8f7dd869a7e116c1704c16ac5ccf4e410042beb8ab3d5bb8fe674ac78d08e12e"),
    ("GPL-1.0", "a2b7ff92ef9c0f3e8dbeb0059a50c26b7f3b5e1a44b4b111fdc0c2b0eb1abeaa"),
    ("GPL-2.0", "1bba23792086a0eb7155489ad462725aafe53bce895bce43d5f64553c0530790"),
    ("GPL-2.0", "4fa828326963f612c7e62caa74da4d9f5ff587e2218a1e3735bddb8a924adea7"),
    ("GPL-2.0", "205f5c49e4b467c629be9a1fce4c2e331792278864d6f72d5fa877ed7d01881a"),
    ("GPL-3.0", "8aef70df45b1578f919d5bc01bdb1f0f5b49c46820eff532d5c0f2bb31087270"),
    ("GPL-3.0", "b680bddc52a444e19fbe7353cf10e5a94bf71cbe416e11422b7d75645a7a2391"),
    ("GPL-3.0", "0e2af0abdcc7b246fc3e273953f9202e896b0c9aa60cbc4e3650cf6d187a8dbe"),
    ("LGPL-2.0", "0b394906f282c03462aa1fc067a643a6dd4ffab5d645400ec00d9302d14133a8"),
    ("LGPL-2.0", "f1646e96e98a1602fe1d3ebfb785284902befc5e456f87a84315c547f7a8fe04"),
    ("LGPL-2.0", "fa4d15e891c72ebd7df9288efbdf81bded9d4313d4f4b76aebf23bcf3dbbe004"),
    ("LGPL-2.1", "9f0935edc6963a95730b9f3d877768a3c92713ab8e7aac4f5aae4bff2c13f064"),
    ("LGPL-2.1", "df721fe1d899c37d2c281b645acde64b083e4220d1ab4da4595982795fd6fce0"),
    ("LGPL-2.1", "ad1d5464f1082f874fa60be0171ca8fab5778488fb373a59991d64d50a05569a"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "17cb1eaaaaa315e84719e30a5eedc76ee4862885df66aa58fd657799db48ed06"),
    ("MPL-2.0", "1b1ad9103975e4267620e04f6a9cd315e74377c35271f5ff48fbc6ebb9f1e8a9"),
]


def spelt(text: Column) -> Column:
    """A text in its one spelling, line by line: what is left of a line that names a holder is empty."""
    x = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.regexp_replace(x, HOLDER, ""), f"(?md){BULLET}", " ")
    return F.regexp_replace(x, OTHER, " ")


def lines_of(text: Column) -> Column:
    """The canonical lines that say something."""
    lines = F.transform(F.split(spelt(text), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def digest_of(lines: Column) -> Column:
    """Digest of a whole text by its canonical lines; titles don't count, nor does where lines end."""
    x = F.array_join(F.filter(lines, lambda x: ~x.isin(TITLES)), " ")
    for a, b in PHRASES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.sha2(x, 256)


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest (of the whole canonical text), license_id (the known license that the whole
    text is, else null), notices (the known ones that whole lines are, sorted and joined by commas; empty if none).

    known: licenses and texts, digested by the same expressions; digests: licenses and digests. Both are fixed lists, so
    the joined table is small and broadcast, and each text is canonicalised once, where it lies: nothing is shuffled.
    Null and empty texts, and texts of titles and holders alone, have the digest of an empty text and no license. Rows
    that share an id, and rows with a null id, are scanned each for itself; an empty table gives no rows; other columns
    play no part.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(known, "_license string, _known string").select("_license", lines_of(F.col("_known")).alias("_lines")).select("_license", digest_of(F.col("_lines")).alias("_k"), F.array_join("_lines", " ").alias("_line"))
    line_license = {r[0]: r[1] for r in table.groupBy("_line").agg(F.min("_license")).filter("_line <> ''").collect()}  # no more than `known`
    whole = table.select("_license", "_k").unionByName(spark.createDataFrame(digests, "_license string, _k string")) if digests else table.select("_license", "_k")
    whole = whole.filter(F.col("_k") != F.sha2(F.lit(""), 256)).groupBy("_k").agg(F.min("_license").alias("_license"))
    rows = docs.select(*[c.alias(n) for c, n in zip(named(id_col, text_col), ("_id", "_text"), strict=True)])
    rows = rows.select("_id", lines_of(F.col("_text").cast("string")).alias("_lines")).select("_id", digest_of(F.col("_lines")).alias("digest"), F.array_intersect("_lines", F.array(*[F.lit(x) for x in line_license])).alias("_hits"))
    of = F.create_map(*[F.lit(y) for x in line_license.items() for y in x])
    notices = F.when(F.size("_hits") == 0, "").otherwise(F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda x: of[x]))), ","))
    return rows.join(F.broadcast(whole), F.col("digest") == F.col("_k"), "left").select(F.col("_id").alias(id_col), "digest", F.col("_license").alias("license_id"), notices.alias("notices"))
