"""Signature rules of licences, one a line: tier, label, keyword, then the signature.

A signature is a regular expression over words in lower case with one blank between them; `@`
stands for any one word.  The keyword is a word that every match has: a text without it is never
tried.  Tier 1: identifiers and wording of the licence itself; 2: a licence named; 3: hints.
Earlier rules go before later ones of their tier.
"""

from __future__ import annotations

from typing import NamedTuple

SIGNATURES = """
1 apache-2.0 apache: spdx license identifier apache 2 0
1 mit mit: spdx license identifier mit
1 mit-0 mit: spdx license identifier mit 0
1 gpl-2.0-only gpl: spdx license identifier gpl 2 0( only)?
1 gpl-2.0-or-later gpl: spdx license identifier gpl 2 0 or later
1 gpl-3.0-only gpl: spdx license identifier gpl 3 0( only)?
1 gpl-3.0-or-later gpl: spdx license identifier gpl 3 0 or later
1 lgpl-2.1-only lgpl: spdx license identifier lgpl 2 1( only)?
1 lgpl-2.1-or-later lgpl: spdx license identifier lgpl 2 1 or later
1 lgpl-3.0-only lgpl: spdx license identifier lgpl 3 0( only)?
1 lgpl-3.0-or-later lgpl: spdx license identifier lgpl 3 0 or later
1 agpl-3.0-only agpl: spdx license identifier agpl 3 0( only)?
1 agpl-3.0-or-later agpl: spdx license identifier agpl 3 0 or later
1 bsd-2-clause bsd: spdx license identifier bsd 2 clause
1 bsd-3-clause bsd: spdx license identifier bsd 3 clause
1 bsd-4-clause bsd: spdx license identifier bsd 4 clause
1 0bsd 0bsd: spdx license identifier 0bsd
1 isc isc: spdx license identifier isc
1 zlib zlib: spdx license identifier zlib
1 mpl-1.1 mpl: spdx license identifier mpl 1 1
1 mpl-2.0 mpl: spdx license identifier mpl 2 0
1 epl-1.0 epl: spdx license identifier epl 1 0
1 epl-2.0 epl: spdx license identifier epl 2 0
1 cddl-1.0 cddl: spdx license identifier cddl 1 0
1 cddl-1.1 cddl: spdx license identifier cddl 1 1
1 eupl-1.2 eupl: spdx license identifier eupl 1 2
1 bsl-1.0 bsl: spdx license identifier bsl 1 0
1 unlicense unlicense: spdx license identifier unlicense
1 wtfpl wtfpl: spdx license identifier wtfpl
1 cc0-1.0 cc0: spdx license identifier cc0 1 0
1 cc-by-3.0 cc: spdx license identifier cc by 3 0
1 cc-by-4.0 cc: spdx license identifier cc by 4 0
1 cc-by-sa-3.0 cc: spdx license identifier cc by sa 3 0
1 cc-by-sa-4.0 cc: spdx license identifier cc by sa 4 0
1 cc-by-nc-4.0 cc: spdx license identifier cc by nc 4 0
1 artistic-2.0 artistic: spdx license identifier artistic 2 0
1 ofl-1.1 ofl: spdx license identifier ofl 1 1
1 postgresql postgresql: spdx license identifier postgresql
1 python-2.0 python: spdx license identifier python 2 0
1 spdx-tag spdx: spdx license identifier( @){1,4}
1 apache-2.0 apache: licensed under the apache license version 2( 0)?
1 apache-2.0 apache: www apache org licenses license 2 0
1 apache-1.1 apache: licensed under the apache (software )?license version 1 1
1 apache-1.0 apache: licensed under the apache (software )?license version 1 0
1 mit charge: permission is hereby granted free of charge to any person obtaining a copy
1 mit sublicense: use copy modify merge publish distribute sublicense and or sell copies
1 mit noninfringement: fitness for a particular purpose and noninfringement
1 mit released: released under the mit license
1 bsd redistribution: redistribution and use in source and binary forms with or without modification are permitted
1 bsd-3-clause endorse: may be used to endorse or promote products derived from this software
1 bsd-4-clause advertising: all advertising materials mentioning features or use of this software
1 bsd redistributions: redistributions of source code must retain the above copyright notice
1 bsd redistributions: redistributions in binary form must reproduce the above copyright notice
1 isc disclaims: the author disclaims all warranties with regard to this software
1 isc hereby: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 zlib misrepresented: the origin of this software must not be misrepresented
1 zlib plainly: altered source versions must be plainly marked as such
1 gpl redistribute: (you can redistribute it|redistribute it) and or modify it under the terms of the gnu( @){0,2} general public license
1 gpl-2.0-or-later later: version 2 of the license or( at your option)? any later version
1 gpl-3.0-or-later later: version 3 of the license or( at your option)? any later version
1 gpl-3.0 gnu: gnu general public license( as published by the free software foundation)?( either)? version 3
1 gpl-2.0 gnu: gnu general public license( as published by the free software foundation)?( either)? version 2
1 gpl-1.0 gnu: gnu general public license( as published by the free software foundation)?( either)? version 1
1 lgpl-3.0 lesser: gnu lesser general public license version 3
1 lgpl-2.1 lesser: gnu lesser general public license version 2 1
1 lgpl-2.0 library: gnu library general public license version 2
1 agpl-3.0 affero: gnu affero general public license version 3
1 gfdl-1.3 documentation: gnu free documentation license version 1 3
1 gfdl-1.2 documentation: gnu free documentation license version 1 2
1 gfdl invariant: with no invariant sections( no front cover texts)?
1 mpl-2.0 mozilla: mozilla public license( v| version)? 2 0
1 mpl-1.1 mozilla: mozilla public license( v| version)? 1 1
1 mpl-2.0 mozilla: mozilla org mpl 2 0
1 epl-2.0 eclipse: eclipse public license( v| version)? 2 0
1 epl-1.0 eclipse: eclipse public license( v| version)? 1 0
1 cddl-1.0 cddl: common development and distribution license cddl version 1 0
1 cpl-1.0 common: common public license version 1 0
1 bsl-1.0 boost: boost software license version 1 0
1 eupl-1.2 union: european union public licence( eupl)?( v)? v?1 2
1 unlicense unencumbered: this is free and unencumbered software released into the public domain
1 unlicense unlicense: unlicense org
1 wtfpl fuck: do what the fuck you want to public license
1 beerware beer: you can buy me a beer in return
1 cc0-1.0 creativecommons: creativecommons org publicdomain zero 1 0
1 pdm-1.0 creativecommons: creativecommons org publicdomain mark 1 0
1 cc-by-2.0 creativecommons: creativecommons org licenses by 2 0
1 cc-by-2.5 creativecommons: creativecommons org licenses by 2 5
1 cc-by-3.0 creativecommons: creativecommons org licenses by 3 0
1 cc-by-4.0 creativecommons: creativecommons org licenses by 4 0
1 cc-by-sa-2.0 creativecommons: creativecommons org licenses by sa 2 0
1 cc-by-sa-2.5 creativecommons: creativecommons org licenses by sa 2 5
1 cc-by-sa-3.0 creativecommons: creativecommons org licenses by sa 3 0
1 cc-by-sa-4.0 creativecommons: creativecommons org licenses by sa 4 0
1 cc-by-nc-3.0 creativecommons: creativecommons org licenses by nc 3 0
1 cc-by-nc-4.0 creativecommons: creativecommons org licenses by nc 4 0
1 cc-by-nd-3.0 creativecommons: creativecommons org licenses by nd 3 0
1 cc-by-nd-4.0 creativecommons: creativecommons org licenses by nd 4 0
1 cc-by-nc-sa-3.0 creativecommons: creativecommons org licenses by nc sa 3 0
1 cc-by-nc-sa-4.0 creativecommons: creativecommons org licenses by nc sa 4 0
1 cc-by-nc-nd-3.0 creativecommons: creativecommons org licenses by nc nd 3 0
1 cc-by-nc-nd-4.0 creativecommons: creativecommons org licenses by nc nd 4 0
1 cc-by-4.0 attribution: creative commons attribution 4 0( international)?
1 cc-by-3.0 attribution: creative commons attribution 3 0( unported)?
1 cc-by-sa-4.0 sharealike: creative commons attribution sharealike 4 0( international)?
1 cc-by-sa-3.0 sharealike: creative commons attribution sharealike 3 0( unported)?
1 cc-by-nc-4.0 noncommercial: creative commons attribution noncommercial 4 0( international)?
1 cc-by-nc-sa-4.0 sharealike: creative commons attribution noncommercial sharealike 4 0( international)?
1 cc-by-nc-nd-4.0 noderivatives: creative commons attribution noncommercial noderivatives 4 0( international)?
1 cc-by-nd-4.0 noderivatives: creative commons attribution noderivatives 4 0( international)?
1 cc-by-1.0 cc: cc by 1 0
1 cc-by-2.0 cc: cc by 2 0
1 cc-by-2.5 cc: cc by 2 5
1 cc-by-3.0 cc: cc by 3 0
1 cc-by-4.0 cc: cc by 4 0
1 cc-by-sa-2.0 cc: cc by sa 2 0
1 cc-by-sa-2.5 cc: cc by sa 2 5
1 cc-by-sa-3.0 cc: cc by sa 3 0
1 cc-by-sa-4.0 cc: cc by sa 4 0
1 cc-by-nc-2.0 cc: cc by nc 2 0
1 cc-by-nc-2.5 cc: cc by nc 2 5
1 cc-by-nc-3.0 cc: cc by nc 3 0
1 cc-by-nc-4.0 cc: cc by nc 4 0
1 cc-by-nd-2.0 cc: cc by nd 2 0
1 cc-by-nd-2.5 cc: cc by nd 2 5
1 cc-by-nd-3.0 cc: cc by nd 3 0
1 cc-by-nd-4.0 cc: cc by nd 4 0
1 cc-by-nc-sa-2.0 cc: cc by nc sa 2 0
1 cc-by-nc-sa-3.0 cc: cc by nc sa 3 0
1 cc-by-nc-sa-4.0 cc: cc by nc sa 4 0
1 cc-by-nc-nd-2.0 cc: cc by nc nd 2 0
1 cc-by-nc-nd-3.0 cc: cc by nc nd 3 0
1 cc-by-nc-nd-4.0 cc: cc by nc nd 4 0
1 cc0-1.0 cc0: cc0 (v|version )?1 0( universal)?
1 ogl-uk-3.0 government: open government licence v3( 0)?
1 ogl-uk-2.0 government: open government licence v2( 0)?
1 odbl-1.0 odbl: odc odbl
1 odbl-1.0 database: open (data commons open )?database license( odbl)?( v?1 0)?
1 odc-by-1.0 attribution: open data commons attribution license
1 pddl-1.0 dedication: public domain dedication and license
1 cdla-permissive-2.0 permissive: community data license agreement permissive( version)? 2 0
1 cdla-sharing-1.0 sharing: community data license agreement sharing( version)? 1 0
1 openrail-m rail: (creativeml )?open rail( plus)?( m)?
1 openrail-m openrail: (creativeml |bigscience |bigcode )?openrail( m)?
1 llama-2 llama: llama 2 community license( agreement)?
1 llama-3 llama: llama 3( @){0,1} community license( agreement)?
1 gemma gemma: gemma terms of use
1 ofl-1.1 sil: sil open font license( version)? 1 1
1 ofl reserved: reserved font name
1 artistic-2.0 artistic: artistic license( version)? 2 0
1 artistic-1.0 artistic: artistic license( version)? 1 0
1 ms-pl microsoft: microsoft public license( ms pl)?
1 ms-rl microsoft: microsoft reciprocal license( ms rl)?
1 sspl-1.0 server: server side public license( version 1)?
1 busl-1.1 business: business source license 1 1
1 elastic-2.0 elastic: elastic license 2 0
1 commons-clause clause: commons clause license condition( v1 0)?
1 polyform-nc-1.0 polyform: polyform noncommercial license 1 0 0
1 polyform-sb-1.0 polyform: polyform small business license 1 0 0
1 upl-1.0 universal: universal permissive license( upl)?( version)? 1 0
1 ncsa ncsa: university of illinois ncsa open source license
1 python-2.0 python: python software foundation license( agreement for python)?
1 python-2.0 psf: psf license( agreement for python)?
1 ruby ruby: ruby license
1 php-3.01 php: php license version 3 01
1 vim vim: vim license
1 afl-3.0 academic: academic free license( version| v)? 3 0
1 osl-3.0 software: open software license( version| v)? 3 0
1 cecill-2.1 cecill: cecill( license| licence)?( version| v)? 2 1
1 isc isc: isc license
1 zlib zlib: zlib( libpng)? license
2 apache apache: apache (software )?licen[cs]ed?
2 apache-2.0 apache: apache( license)? v?2( 0)?
2 mit mit: mit licen[cs]ed?
2 mit expat: expat license
2 bsd bsd: bsd( style)? licen[cs]ed?
2 bsd-2-clause bsd: (simplified bsd license|bsd 2 clause|2 clause bsd( license)?)
2 bsd-2-clause freebsd: freebsd license
2 bsd-3-clause bsd: (bsd 3 clause|new bsd license|revised bsd license|modified bsd license|3 clause bsd( license)?)
2 bsd-4-clause bsd: (bsd 4 clause|original bsd license|4 clause bsd( license)?)
2 gpl gnu: gnu( @){0,1} gpl
2 gpl-2.0 gplv2: gplv2
2 gpl-3.0 gplv3: gplv3
2 gpl-2.0-or-later gpl: gpl( v| version)? v?2( 0)? or later
2 gpl-3.0-or-later gpl: gpl( v| version)? v?3( 0)? or later
2 gpl gpl: gpl licen[cs]ed?
2 lgpl lgpl: lgpl( v?[23]( [01])?)?
2 lgpl lesser: lesser general public license
2 agpl agpl: agpl( v?3( 0)?)?
2 agpl affero: affero general public license
2 gfdl documentation: (gnu )?free documentation license
2 mpl mozilla: mozilla public license
2 mpl mpl: mpl( v)? [12] [01]
2 epl eclipse: eclipse (public|distribution) license
2 cddl cddl: cddl
2 bsl-1.0 boost: boost (software )?license
2 eupl eupl: eupl( v?1 [012])?
2 unlicense unlicense: (the )?unlicense
2 wtfpl wtfpl: wtfpl
2 beerware beerware: beerware
2 cc0-1.0 cc0: cc0
2 cc-by-sa cc: cc by sa
2 cc-by-nc cc: cc by nc
2 cc-by-nd cc: cc by nd
2 cc-by-nc-sa cc: cc by nc sa
2 cc-by-nc-nd cc: cc by nc nd
2 creative-commons commons: creative commons( @){0,3} licen[cs]ed?
2 creative-commons commons: creative commons attribution( @){0,2}
2 public-domain domain: (in|into|to) the public domain
2 public-domain domain: public domain (work|mark|notice)
2 ogl government: open government licence
2 ofl font: open font license
2 artistic artistic: artistic license
2 openrail openrail: openrail
2 proprietary proprietary: proprietary (and confidential|license|software)
2 proprietary confidential: confidential and proprietary
2 proprietary unauthorized: unauthorized (copying|use|reproduction|distribution)( @){0,3} (is )?(strictly )?prohibited
2 shareware shareware: shareware
2 freeware freeware: freeware
2 commercial commercial: commercial licen[cs]e
2 non-commercial noncommercial: (for )?noncommercial (use|purposes)( only)?
2 non-commercial commercial: (for )?non commercial (use|purposes)( only)?
2 research-only research: for research (use|purposes) only
2 no-derivatives derivatives: no derivatives
2 share-alike alike: share alike
3 license-notice licensed: (is |are |dual )?licensed under( the)?( terms of( the)?)?
3 license-notice released: (is |are )?released under( the)?( terms of( the)?)?
3 license-notice distributed: (is |are )?distributed under( the)?( terms of( the)?)?
3 license-notice terms: under the terms of( the| this)?( @){0,3} (license|licence|agreement)
3 license-notice license: see (the )?license( file)?( for( @){1,3})?
3 license-notice license: (this|the) (software|work|library|program|document)( @){0,2} license
3 open-source source: open source (software|licen[cs]ed?|initiative)
3 free-software free: free software( foundation)?
3 copyleft copyleft: copyleft
3 copyright copyright: copyright( c)?( (19|20)[0-9][0-9]){1,4}( by)?
3 copyright copyright: copyright (notice|holders?|owners?)
3 warranty warranty: (without( any)? warranty|no warranty)( of any kind)?
3 warranty warranties: without warranties( or conditions)? of any kind
3 liability liable: in no event shall( @){1,6} be liable
3 permission permission: (with|by) (kind )?permission of( the)?( @){1,2}
3 permission reproduced: no part of this (work|book|publication|document) may be reproduced
3 attribution attribution: attribution (is )?required
3 terms terms: terms (of (use|service)|and conditions)
3 trademark trademark: (registered )?trademark of( @){1,2}
3 trademark trademarks: (registered )?trademarks of( @){1,2}
3 patent patent: patent (license|grant|pending)
3 end-user eula: eula
3 end-user end: end user licen[cs]e agreement
"""


class Rule(NamedTuple):
    rule: int
    tier: int
    label: str
    keyword: str
    pattern: str
    base: bool


#: Phrases whose places count as such and whose labels always stay: fixed by the contract.
BASE = (("cc-by", "cc", "cc by"), ("gpl", "public", "general public license"), ("reserved", "reserved", "all rights reserved"))


def marked(signature: str) -> str:
    """The signature over words that are each written between < and >."""
    return "<" + signature.replace("@", "[^<>]+").replace(" ", "><") + ">"


def read(signatures: str, base: tuple[tuple[str, str, str], ...] = BASE) -> list[Rule]:
    """The base phrases, then the rules of the lines."""
    rules = [Rule(k, 2, label, keyword, marked(phrase), True) for k, (label, keyword, phrase) in enumerate(base)]
    for line in signatures.strip().splitlines():
        head, signature = line.split(": ", 1)
        tier, label, keyword = head.split()
        rules.append(Rule(len(rules), int(tier), label, keyword, marked(signature), False))
    return rules


RULES = read(SIGNATURES)
