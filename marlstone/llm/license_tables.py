"""Known licence sentences and the ordered rules over them. Wording and names of public licences."""

from __future__ import annotations

#: Licences as grants name them: identifier and pattern over a normalised sentence.
NAMES: dict[str, str] = {
    "AGPL-3.0": r"(?:gnu )?(?:affero general public license|agpl)(?: v(?:ersion)? ?)? ?3(?: 0)?",
    "LGPL-3.0": r"(?:gnu )?(?:lesser general public license|lgpl)(?: v(?:ersion)? ?)? ?3(?: 0)?",
    "LGPL-2.1": r"(?:gnu )?(?:lesser general public license|lgpl)(?: v(?:ersion)? ?)? ?2 1",
    "GPL-3.0": r"(?:gnu )?(?:general public license|gpl)(?: v(?:ersion)? ?)? ?3(?: 0)?",
    "GPL-2.0": r"(?:gnu )?(?:general public license|gpl)(?: v(?:ersion)? ?)? ?2(?: 0)?",
    "Apache-2.0": r"apache(?: software)? license(?: v(?:ersion)? ?)? ?2(?: 0)?|apache 2(?: 0)?(?: license)?|asl 2(?: 0)?",
    "MIT": r"(?:mit|expat)(?: x11)?(?: license)?",
    "BSD-2-Clause": r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: license)?",
    "BSD-3-Clause": r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|bsd)(?: style)?(?: license)?",
    "ISC": r"isc(?: license)?",
    "MPL-2.0": r"(?:mozilla public license|mpl)(?: v(?:ersion)? ?)? ?2(?: 0)?",
    "EPL-2.0": r"(?:eclipse public license|epl)(?: v(?:ersion)? ?)? ?2(?: 0)?",
    "BSL-1.0": r"boost software license(?: v(?:ersion)? ?)? ?1(?: 0)?",
    "Zlib": r"zlib(?: libpng)?(?: license)?",
    "CC0-1.0": r"(?:creative commons )?cc ?0(?: v(?:ersion)?)?(?: 1(?: 0)?)?(?: universal)?(?: public domain dedication)?",
    "CC-BY-NC-SA": r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: license)?(?: (?P<a>[1-4] [05]))?(?: international)?(?: license)?",
    "CC-BY-NC-ND": r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: license)?(?: (?P<b>[1-4] [05]))?(?: international)?(?: license)?",
    "CC-BY-NC": r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: license)?(?: (?P<c>[1-4] [05]))?(?: international)?(?: license)?",
    "CC-BY-SA": r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: license)?(?: (?P<d>[1-4] [05]))?(?: international)?(?: license)?",
    "CC-BY-ND": r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)(?: license)?(?: (?P<e>[1-4] [05]))?(?: international)?(?: license)?",
    "CC-BY": r"(?:cc|creative commons) (?:by|attribution)(?: license)?(?: (?P<f>[1-4] [05]))?(?: international)?(?: license)?",
    "EUPL": r"(?:european union public license|eupl)(?: v(?:ersion)? ?)?(?: ?(?P<g>1 [012]))?",
    "Artistic": r"artistic license(?: v(?:ersion)? ?)?(?: ?(?P<h>[12](?: 0)?))?",
    "CDDL": r"(?:common development and distribution license|cddl)(?: v(?:ersion)? ?)?(?: ?(?P<i>1 [01]))?",
    "OFL-1.1": r"(?:sil )?(?:open font license|ofl)(?: v(?:ersion)? ?)?(?: ?1 1)?",
    "MS-PL": r"(?:microsoft public license|ms pl)",
    "BUSL-1.1": r"(?:business source license|busl)(?: v(?:ersion)? ?)?(?: ?1 1)?",
    "SSPL-1.0": r"(?:server side public license|sspl)(?: v(?:ersion)? ?)?(?: ?1(?: 0)?)?",
    "PSF-2.0": r"(?:python software foundation license|psf license)(?: v(?:ersion)? ?)?(?: ?2(?: 0)?)?",
    "Unlicense": r"unlicense",
    "WTFPL": r"(?:do what the fuck you want to public license|wtfpl)(?: v(?:ersion)? ?)?(?: ?2)?",
}

#: What stands before the name in a sentence that grants a licence, and after it.
GRANT = r"\b(?:licensed|released|distributed|available|provided|published|offered|shared|covered|redistributed|used)(?: to you)? (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:either )?"
LATER = r"(?: license)?(?: as published by the free software foundation)? or (?:at your option )?(?:any )?later"

#: Sentences with a fixed wording: identifier and normalised sentence, ``*`` for up to twelve words.
SENTENCES: dict[str, str] = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "* redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "* redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "* neither the name of * nor the names of * contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at *",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-later": "* free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-later": "* free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gnu-hope": "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gnu-see": "see the gnu * general public license for more details",
    "gnu-copy": "you should have received a copy of the gnu * license along with this *",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at *",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "apache-license-means": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache-licensor-means": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "apache-copyright-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "gnu-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl3-freedom": "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "gpl2-preamble": "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    "gpl2-freedom": "the licenses for most software are designed to take away your freedom to share and change it",
    "agpl3-preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl3-terms": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl21-first": "this is the first released version of the lesser gpl",
    "lgpl21-successor": "it also counts as the successor of the gnu library public license version 2 hence the version number 2 1",
    "epl2-provided": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "epl2-acceptance": "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
    "mpl2-covered": "covered software means source code form to which the initial contributor has attached the notice in exhibit a the executable form of such source code form and modifications of such source code form in each case including portions thereof",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl-notice": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    "bsl-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement",
    "bsl-liability": "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "unlicense-dedicate": "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "wtfpl-verbatim": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "wtfpl-do": "you just do what the fuck you want to",
    "cc0-dedicated": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "cc0-may": "you can copy modify distribute and perform the work even for commercial purposes all without asking permission",
    "cc-by-legal": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license public license",
    "cc-by-sa-legal": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license public license",
    "cc-by-nd-legal": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noderivatives 4 0 international public license public license",
    "cc-by-nc-legal": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license public license",
    "cc-by-nc-sa-legal": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license public license",
    "cc-by-nc-nd-legal": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license public license",
    "ofl-grant": "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions",
    "eupl-licensor": "licensed under the eupl following the copyright notice for the work",
    "public-domain": "* released into the public domain *",
    "rights-reserved": "all rights reserved",
}

#: Sentences that say nothing of the licence: they may stand between those of a rule.
NEUTRAL = {"copyright", "rights-reserved"}

#: What a rule gives as its licence when the sentence itself names it.
NAMED = ""

#: Ordered rules: licence and sequence of identifiers; ``?`` after one that may be missing, ``*`` at the end of one for whatever name a sentence grants or a tag states.
#: The first rule that matches at a place takes its sentences.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("grant:MIT?", "mit-grant", "mit-notice", "mit-as-is", "mit-liability?")),
    ("MIT", ("mit-grant", "mit-notice?")),
    ("ISC", ("grant:ISC?", "isc-grant", "isc-as-is?", "isc-liability?")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is?", "bsd-liability?")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is?", "bsd-liability?")),
    ("Apache-2.0", ("grant:Apache-2.0", "apache-comply?", "apache-copy?", "apache-as-is?", "apache-see?")),
    ("Apache-2.0", ("apache-as-is", "apache-see?")),
    ("AGPL-3.0-or-later", ("agpl3-later", "gnu-hope?", "gnu-see?", "gnu-copy?")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gnu-hope?", "gnu-see?", "gnu-copy?")),
    ("LGPL-2.1-or-later", ("lgpl21-later", "gnu-hope?", "gnu-see?", "gnu-copy?")),
    ("GPL-3.0-or-later", ("gpl3-later", "gnu-hope?", "gnu-see?", "gnu-copy?")),
    ("GPL-2.0-or-later", ("gpl2-later", "gnu-hope?", "gnu-see?", "gnu-copy?")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy?")),
    ("Unlicense", ("unlicense-domain", "unlicense-free?")),
    ("Apache-2.0", ("apache-license-means", "apache-licensor-means?")),
    ("Apache-2.0", ("apache-licensor-means",)),
    ("Apache-2.0", ("apache-copyright-grant",)),
    ("GPL-3.0", ("gnu-verbatim?", "gpl3-preamble", "gpl3-freedom?")),
    ("GPL-2.0", ("gnu-verbatim?", "gpl2-freedom", "gpl2-preamble?")),
    ("GPL-2.0", ("gpl2-preamble",)),
    ("GPL-3.0", ("gpl3-freedom",)),
    ("AGPL-3.0", ("gnu-verbatim?", "agpl3-preamble", "gpl3-freedom?")),
    ("LGPL-3.0", ("gnu-verbatim?", "lgpl3-terms")),
    ("LGPL-2.1", ("gnu-verbatim?", "lgpl21-first", "lgpl21-successor?")),
    ("EPL-2.0", ("epl2-provided", "epl2-acceptance?")),
    ("MPL-2.0", ("mpl2-covered",)),
    ("BSL-1.0", ("grant:BSL-1.0?", "bsl-grant", "bsl-notice?", "bsl-as-is?", "bsl-liability?")),
    ("Unlicense", ("unlicense-free", "unlicense-dedicate?")),
    ("Zlib", ("grant:Zlib?", "zlib-as-is?", "zlib-grant", "zlib-origin?", "zlib-altered?", "zlib-notice?")),
    ("WTFPL", ("wtfpl-verbatim?", "wtfpl-do")),
    ("WTFPL", ("wtfpl-verbatim",)),
    ("CC0-1.0", ("cc0-dedicated", "cc0-may?")),
    ("CC-BY-4.0", ("cc-by-legal",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-legal",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-legal",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-legal",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-legal",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-legal",)),
    ("OFL-1.1", ("ofl-grant",)),
    ("EUPL", ("eupl-licensor",)),
    ("Public-Domain", ("public-domain",)),
    (NAMED, ("grant:*",)),
    (NAMED, ("spdx:*",)),
]
