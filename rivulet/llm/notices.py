"""Hand-written signatures of license texts and notices, for ``licenses``.

Each is a run of words of the text, with anything but words between them, so
that line breaks, comment marks and punctuation do not matter.  The word in
capitals is the signature's keyword: only texts that contain it are searched.
"""

from __future__ import annotations

#: Words of license texts and notices that name no license family by version, by label.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": ("the above copyright notice and this permission notice shall be included in all copies or SUBSTANTIAL portions", "without limitation the rights to use copy modify merge publish distribute SUBLICENSE and or sell copies"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or WITHOUT fee is hereby granted provided",),
    "0bsd": ("permission to use copy modify and or distribute this software for any purpose with or WITHOUT fee is hereby granted the software is provided",),
    "bsd": ("REDISTRIBUTIONS of source code must retain the above copyright notice", "REDISTRIBUTIONS in binary form must reproduce the above copyright notice", "this software is provided by the copyright holders and CONTRIBUTORS as is"),
    "bsd-3-clause": ("neither the name of the copyright holder nor the names of its contributors may be used to ENDORSE", "neither the name of the nor the names of its contributors may be used to ENDORSE", "the names of its contributors may not be used to ENDORSE"),
    "bsd-4-clause": ("all ADVERTISING materials mentioning features or use of this software must display",),
    "apache-2.0": ("you may not use this file except in COMPLIANCE with the license", "www APACHE org licenses license 2 0", "licensed to the apache software foundation asf under one or more CONTRIBUTOR license agreements", "work means the work of AUTHORSHIP whether in source or object form made available under the license"),
    "apache-1.1": ("products derived from this software may not be called APACHE",),
    "gpl": ("it under the terms of the gnu general public license as PUBLISHED by the free software foundation", "you should have received a copy of the gnu GENERAL public license along", "everyone is permitted to copy and distribute VERBATIM copies of this license document"),
    "gpl-2.0": ("the licenses for most software are designed to take away your FREEDOM to share and change it", "activities other than copying distribution and modification are not COVERED by this license"),
    "gpl-2.0-or-later": ("either version 2 of the license or at your OPTION any later version",),
    "gpl-3.0": ("the gnu general public license is a free COPYLEFT license for software and other kinds of works", "to PROPAGATE a work means to do anything with it that without permission would make you"),
    "gpl-3.0-or-later": ("either version 3 of the license or at your OPTION any later version",),
    "lgpl": ("you should have received a copy of the gnu LESSER general public license along", "you should have received a copy of the gnu LIBRARY general public license along"),
    "lgpl-2.1-or-later": ("either version 2 1 of the license or at your OPTION any later version",),
    "agpl": ("you should have received a copy of the gnu AFFERO general public license along", "remote network INTERACTION use with the gnu general public license"),
    "linking-exception": ("as a special exception the copyright holders of this library give you permission to link this library with INDEPENDENT modules", "as a special exception if other files INSTANTIATE templates or use macros or inline functions from this file"),
    "gfdl": ("this license is a kind of COPYLEFT which means that derivative works of the document must themselves be free", "with no INVARIANT sections no front cover texts and no back cover texts"),
    "mpl-2.0": ("if a copy of the mpl was not DISTRIBUTED with this file", "this source code form is subject to the terms of the MOZILLA public license"),
    "mpl": ("the contents of this file are subject to the MOZILLA public license",),
    "epl": ("the ACCOMPANYING program is provided under the terms of this eclipse public license", "this program and the ACCOMPANYING materials are made available under the terms of the eclipse"),
    "cddl": ("the contents of this file are subject to the terms of the common DEVELOPMENT and distribution license",),
    "bsl-1.0": ("permission is hereby granted free of charge to any person or ORGANIZATION obtaining a copy of the software and accompanying documentation",),
    "zlib": ("the origin of this software must not be MISREPRESENTED", "altered source versions must be plainly MARKED as such"),
    "unlicense": ("this is free and UNENCUMBERED software released into the public domain", "anyone is free to copy modify publish use COMPILE sell or distribute this software"),
    "wtfpl": ("do what the FUCK you want to public license", "you just do what the FUCK you want to"),
    "cc0-1.0": ("CREATIVECOMMONS org publicdomain zero 1 0", "has waived all copyright and related or NEIGHBORING rights"),
    "public-domain": ("CREATIVECOMMONS org publicdomain mark", "the author DISCLAIMS copyright to this source code", "this software is a work of the united states GOVERNMENT and is not subject to copyright protection"),
    "blessing": ("may you do good and not EVIL may you find forgiveness for yourself",),
    "postgresql": ("for any purpose without fee and without a WRITTEN agreement is hereby granted",),
    "python-2.0": ("psf is making python available to LICENSEE on an as is basis",),
    "openssl": ("this product includes software developed by the OPENSSL project",),
    "ssleay": ("this product includes CRYPTOGRAPHIC software written by eric young",),
    "artistic-1.0": ("the intent of this document is to state the conditions under which a PACKAGE may be copied",),
    "artistic-2.0": ("this license ESTABLISHES the terms under which a given free software package may be copied",),
    "ofl": ("the font software may be sold as part of a larger software package but no copy of one or more of the font software TYPEFACES may be sold by itself", "the goals of the open font license ofl are to stimulate WORLDWIDE development"),
    "x11": ("except as contained in this notice the name of the x CONSORTIUM shall not be used in advertising",),
    "icu": ("except as contained in this notice the name of a copyright holder shall not be used in ADVERTISING",),
    "hpnd": ("permission to use copy modify and distribute this software and its DOCUMENTATION for any purpose and without fee is hereby granted",),
    "ncsa": ("neither the names of nor the names of its contributors may be used to ENDORSE or promote products derived from this software without specific prior written permission developed by",),
    "json": ("the software shall be used for good not EVIL",),
    "beerware": ("if we meet some day and you think this stuff is WORTH it you can buy me a beer",),
    "ijg": ("this software is based in part on the work of the independent JPEG group",),
    "ftl": ("portions of this software are copyright the FREETYPE project", "the FREETYPE project license"),
    "bitstream-vera": ("the names BITSTREAM and vera must not be used",),
    "ubuntu-font-1.0": ("UBUNTU font licence version 1 0",),
    "curl": ("curl is licensed under a license INSPIRED by mit x",),
    "info-zip": ("redistributions in compiled form executables and self EXTRACTING archives must reproduce the above copyright notice",),
    "imagemagick": ("IMAGEMAGICK license",),
    "libtiff": ("the name of sam leffler and silicon graphics may not be used in any ADVERTISING or publicity relating to the software",),
    "lua": ("LUA is licensed under the terms of the mit license",),
    "tcl": ("the authors hereby grant permission to use copy modify distribute and license this software and its DOCUMENTATION for any purpose provided that existing copyright notices",),
    "w3c": ("W3C software notice and license", "W3C software and document license"),
    "unicode": ("unicode data files include all data files under the directories", "UNICODE inc license agreement data files and software"),
    "blueoak-1.0.0": ("BLUE oak model license",),
    "mulanpsl-2.0": ("MULAN permissive software license",),
    "upl-1.0": ("UNIVERSAL permissive license",),
    "ms-pl": ("MICROSOFT public license",),
    "ms-rl": ("MICROSOFT reciprocal license",),
    "cpl-1.0": ("the accompanying program is provided under the terms of this COMMON public license", "common public license version 1 0"),
    "ipl-1.0": ("the accompanying program is provided under the terms of this ibm public license", "IBM public license version 1 0"),
    "apsl": ("APPLE public source license",),
    "npl": ("NETSCAPE public license",),
    "qpl": ("the Q public license",),
    "rpl": ("RECIPROCAL public license",),
    "sissl": ("sun industry STANDARDS source license",),
    "sleepycat": ("SLEEPYCAT license", "redistributions in any form must be ACCOMPANIED by information on how to obtain complete source code"),
    "nethack": ("NETHACK general public license",),
    "wxwindows": ("WXWINDOWS library licence",),
    "watcom": ("sybase open WATCOM public license",),
    "lal-1.3": ("FREE art license", "licence ART libre"),
    "ogl-uk": ("open GOVERNMENT licence",),
    "etalab": ("licence ouverte ETALAB", "ETALAB open licence"),
    "dl-de": ("datenlizenz DEUTSCHLAND", "data LICENCE germany"),
    "cdla-permissive": ("community data license agreement PERMISSIVE",),
    "cdla-sharing": ("community data license agreement SHARING",),
    "pddl": ("open data commons public domain DEDICATION and license",),
    "cern-ohl": ("CERN open hardware licence",),
    "solderpad": ("SOLDERPAD hardware license",),
    "tapr-ohl": ("TAPR open hardware license",),
    "busl-1.1": ("BUSINESS source license 1 1", "the licensor hereby grants you the right to copy modify create derivative works REDISTRIBUTE and make non production use"),
    "sspl-1.0": ("SERVER side public license",),
    "elastic-2.0": ("ELASTIC license 2 0", "you may not provide the software to third parties as a HOSTED or managed service"),
    "commons-clause": ("the license does not grant to you the right to sell the software under the foregoing COMMONS clause", "COMMONS clause license condition"),
    "polyform": ("POLYFORM noncommercial license", "POLYFORM shield license", "POLYFORM small business license", "POLYFORM strict license"),
    "fsl": ("FUNCTIONAL source license",),
    "hippocratic": ("HIPPOCRATIC license",),
    "anti-996": ("ANTI 996 license",),
    "parity": ("PARITY public license",),
    "cal-1.0": ("cryptographic AUTONOMY license",),
    "openrail": ("creativeml open RAIL m", "responsible ai license OPENRAIL"),
    "llama": ("LLAMA 2 community license agreement", "LLAMA 3 community license agreement"),
    "ecl-2.0": ("EDUCATIONAL community license",),
    "nasa-1.3": ("NASA open source agreement",),
    "eudatagrid": ("eu DATAGRID software license",),
    "vsl-1.0": ("VOVIDA software license",),
    "sgi-b": ("SGI free software license b",),
    "erlpl": ("ERLANG public license",),
    "zend": ("ZEND license",),
    "proprietary": ("CONFIDENTIAL and proprietary", "unauthorized copying of this file via any medium is strictly PROHIBITED", "may not be REPRODUCED or redistributed without the prior written permission", "no part of this PUBLICATION may be reproduced", "alle rechte VORBEHALTEN", "tous droits RÉSERVÉS", "todos los derechos RESERVADOS"),
}


def signatures() -> list[tuple[str, str, str]]:
    """(label, keyword, pattern) of every notice, for texts whose letters are small."""
    out = []
    for label, phrases in NOTICES.items():
        for phrase in phrases:
            keyword = next((w for w in phrase.split() if w.isupper() and len(w) > 1), max(phrase.split(), key=len)).lower()
            out.append((label, keyword, r"(?<!\w)" + r"\W{1,8}".join(phrase.lower().split()) + r"(?!\w)"))
    return out
