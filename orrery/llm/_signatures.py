"""License signatures, written by hand: names, versions, notices and sentences of public licenses.

A block begins with a family and its keywords in brackets, one of which is in every
match of the block's rules.  A rule is a priority (4 notices, 3 versions and whole
names, 2 names, 1 loose mentions), a label, and a pattern of lower-case words joined
by single spaces.  In a block, rules stand before those that match less of the same words.
"""

SIGNATURES = r"""
[mit: mit, permission is hereby granted, x11, expat]
4 mit permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
4 mit permission is hereby granted free of charge to any person obtaining a copy
3 mit-0 mit no attribution(?: licen[cs]e)?
3 mit-0 mit 0 licen[cs]e
3 x11 x11 licen[cs]e
3 x11 mit x11(?: consortium)?(?: style)? licen[cs]e
3 expat expat licen[cs]e
2 expat (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?expat
2 mit (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
2 mit (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit
3 mit (?:is|are) mit licensed
2 mit mit style licen[cs]e
2 mit mit licen[cs]e
2 mit licen[cs]e mit
1 mit mit licensed

[apache: apache, asl, asf , you may not use this file except]
4 apache-2.0 licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
4 apache you may not use this file except in compliance with the licen[cs]e
4 apache-2.0 licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements
3 apache-2.0-llvm-exception apache(?: licen[cs]e)?(?: version)? v?2 0 with llvm exceptions?
3 apache-2.0-or-later apache licen[cs]e version 2(?: 0)? or (?:any )?later
3 apache-2.0 apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?
3 apache-2.0 apache(?: software)? licen[cs]e v2(?: 0)?
3 apache-2.0 apache version 2 0
3 apache-2.0 apache v?2 0
3 apache-2.0 asl v?2 0
3 apache-2.0 asf v?2 0
3 apache-1.1 asf v?1 1
3 apache-1.1 apache(?: software)? licen[cs]e(?: version| v)? 1 1
3 apache-1.1 apache v?1 1
3 apache-1.0 apache(?: software)? licen[cs]e(?: version| v)? 1 0
2 apache (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache licen[cs]e
2 apache apache(?: software)?(?: style)? licen[cs]e
2 apache licen[cs]e apache
1 apache apache licensed

[gpl: gpl, general public, terms of the gnu]
4 gpl-2.0-or-later redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
4 gpl-3.0-or-later redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
4 gpl redistribute it and or modify it under the terms of the gnu general public licen[cs]e
4 gpl redistribute it and or modify it under the terms of the gnu
4 gpl you should have received a copy of the gnu general public licen[cs]e
4 gpl see the gnu general public licen[cs]e for more details
3 gpl-2.0-classpath-exception (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?2(?: 0)? with (?:the )?classpath exception
3 gpl-3.0-or-later (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)? or (?:at your option )?(?:any )?later
3 gpl-3.0-or-later (?:gnu )?gpl(?: version| v)? ?3(?: 0)? or (?:any )?later
3 gpl-3.0-or-later gpl 3 0 or later
3 gpl-3.0 (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?
3 gpl-3.0 (?:gnu )?general public licen[cs]e v3(?: 0)?
3 gpl-3.0 (?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? 3(?: 0)?
3 gpl-3.0 (?:gnu )?gpl ?v3(?: 0)?
3 gpl-2.0-or-later (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)? or (?:at your option )?(?:any )?later
3 gpl-2.0-or-later (?:gnu )?gpl(?: version| v)? ?2(?: 0)? or (?:any )?later
3 gpl-2.0 (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?
3 gpl-2.0 (?:gnu )?general public licen[cs]e v2(?: 0)?
3 gpl-2.0 (?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? 2(?: 0)?
3 gpl-2.0 (?:gnu )?gpl ?v2(?: 0)?
3 gpl-1.0 (?:gnu )?general public licen[cs]e(?: version| v)? 1(?: 0)?
3 gpl-1.0 (?:gnu )?gpl(?: version| v)? 1 0
2 gpl (?:gnu )?general public licen[cs]e
2 gpl (?:gnu )?gpl licen[cs]e
2 gpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
1 gpl licen[cs]e (?:gnu )?gpl

[lgpl: lgpl, lesser general, library general]
4 lgpl redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
4 lgpl you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
3 lgpl-3.0-or-later (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)? or (?:any )?later
3 lgpl-3.0-or-later (?:gnu )?lgpl(?: version| v)? ?3(?: 0)? or (?:any )?later
3 lgpl-2.1-or-later (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1 or (?:any )?later
3 lgpl-2.1-or-later (?:gnu )?lgpl(?: version| v)? ?2 1 or (?:any )?later
3 lgpl-3.0 (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?
3 lgpl-3.0 (?:gnu )?lgpl(?: version| v)? ?3(?: 0)?
3 lgpl-3.0 lgplv3(?: 0)?
3 lgpl-2.1 (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1
3 lgpl-2.1 (?:gnu )?lgpl(?: version| v)? ?2 1
3 lgpl-2.1 lgplv2 1
3 lgpl-2.0 (?:gnu )?library general public licen[cs]e(?: version| v)? 2(?: 0)?
3 lgpl-2.0 (?:gnu )?lgpl(?: version| v)? ?2(?: 0)?
2 lgpl (?:gnu )?(?:lesser|library) general public licen[cs]e
2 lgpl (?:gnu )?lgpl licen[cs]e
2 lgpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
1 lgpl licen[cs]e (?:gnu )?lgpl

[agpl: agpl, affero]
4 agpl redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
4 agpl you should have received a copy of the gnu affero general public licen[cs]e
3 agpl-3.0-or-later (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)? or (?:any )?later
3 agpl-3.0-or-later (?:gnu )?agpl(?: version| v)? ?3(?: 0)? or (?:any )?later
3 agpl-3.0 (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?
3 agpl-3.0 (?:gnu )?agpl(?: version| v)? ?3(?: 0)?
3 agpl-3.0 agplv3(?: 0)?
3 agpl-1.0 affero general public licen[cs]e(?: version| v)? 1(?: 0)?
2 agpl (?:gnu )?affero general public licen[cs]e
2 agpl (?:gnu )?agpl licen[cs]e
2 agpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
1 agpl licen[cs]e (?:gnu )?agpl

[bsd: bsd, redistribution and use, berkeley, neither the name]
4 bsd-2-clause redistribution and use in source and binary forms with or without modification are permitted
4 bsd redistribution and use of this software in source and binary forms
4 bsd-3-clause neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
3 bsd-4-clause bsd 4 clause(?: licen[cs]e)?
3 bsd-4-clause (?:original|old) bsd licen[cs]e
3 bsd-3-clause-clear (?:clear bsd licen[cs]e|bsd 3 clause clear(?: licen[cs]e)?)
3 bsd-3-clause-lbnl bsd 3 clause lbnl
3 bsd-3-clause bsd 3 clause(?: licen[cs]e)?
3 bsd-3-clause (?:3|three) clause bsd(?: style)?(?: licen[cs]e)?
3 bsd-3-clause (?:new|modified|revised) bsd licen[cs]e
3 bsd-2-clause-patent bsd 2 clause (?:plus )?patent(?: licen[cs]e)?
3 bsd-2-clause-views bsd 2 clause (?:views|freebsd)(?: licen[cs]e)?
3 bsd-2-clause bsd 2 clause(?: licen[cs]e)?
3 bsd-2-clause (?:2|two) clause bsd(?: style)?(?: licen[cs]e)?
3 bsd-2-clause (?:simplified|free) ?bsd licen[cs]e
3 0bsd (?:bsd zero clause(?: licen[cs]e)?|zero clause bsd(?: licen[cs]e)?|0bsd)
3 bsd-1-clause bsd 1 clause(?: licen[cs]e)?
2 bsd (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)? licen[cs]e
2 bsd (?:berkeley|bsd)(?: software distribution)?(?: style| type)? licen[cs]e
2 bsd (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?bsd
2 bsd licen[cs]e bsd
1 bsd bsd licensed

[mpl: mpl, mozilla public]
4 mpl-2.0 this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
4 mpl-1.1 the contents of this file are subject to the mozilla public licen[cs]e version 1 1
3 mpl-2.0-no-copyleft-exception mpl 2 0 no copyleft exception
3 mpl-2.0 mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
3 mpl-2.0 mpl(?: version| v)? ?2(?: 0)?
3 mpl-1.1 mozilla public licen[cs]e(?: version| v)? 1 1
3 mpl-1.1 mpl(?: version| v)? ?1 1
3 mpl-1.0 mozilla public licen[cs]e(?: version| v)? 1 0
3 mpl-1.0 mpl(?: version| v)? ?1 0
2 mpl mozilla public licen[cs]e
2 mpl mpl licen[cs]e
1 mpl licensed under (?:the )?mpl

[eclipse: eclipse public, epl, eclipse distribution]
4 epl-1.0 made available under the terms of the eclipse public licen[cs]e v1 0
4 epl-2.0 made available under the terms of the eclipse public licen[cs]e 2 0
3 epl-2.0 eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
3 epl-2.0 epl(?: version| v)? ?2 0
3 epl-1.0 eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
3 epl-1.0 epl(?: version| v)? ?1 0
3 edl-1.0 eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)?
2 epl eclipse public licen[cs]e
2 edl eclipse distribution licen[cs]e

[cddl: cddl, common development and distribution]
4 cddl the contents of this file are subject to the terms of the common development and distribution licen[cs]e
3 cddl-1.1 common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 1
3 cddl-1.0 common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1(?: 0)?
3 cddl-1.1 cddl(?: version| v)? ?1 1
3 cddl-1.0 cddl(?: version| v)? ?1(?: 0)?
2 cddl common development and distribution licen[cs]e
2 cddl cddl licen[cs]e

[common public: common public, ibm public]
3 cpl-1.0 common public licen[cs]e(?: version| v)? 1(?: 0)?
3 ipl-1.0 ibm public licen[cs]e(?: version| v)? 1(?: 0)?
2 cpl common public licen[cs]e
2 ipl ibm public licen[cs]e

[creative commons: creative commons, cc by, cc0, waived all copyright]
4 cc0-1.0 to the extent possible under law(?: [^ ]+){1,12} waived all copyright and related or neighboring rights
4 cc this work is licensed under a creative commons
3 cc0-1.0 creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?
3 cc0-1.0 cc0 1 0(?: universal)?
3 cc0-1.0 cc0 (?:licen[cs]e|universal|public domain dedication)
3 cc-by-nc-nd-4.0 cc by nc nd 4 0
3 cc-by-nc-nd-3.0 cc by nc nd 3 0
3 cc-by-nc-sa-4.0 cc by nc sa 4 0
3 cc-by-nc-sa-3.0 cc by nc sa 3 0
3 cc-by-nc-4.0 cc by nc 4 0
3 cc-by-nc-3.0 cc by nc 3 0
3 cc-by-nd-4.0 cc by nd 4 0
3 cc-by-nd-3.0 cc by nd 3 0
3 cc-by-sa-4.0 cc by sa 4 0
3 cc-by-sa-3.0 cc by sa 3 0
3 cc-by-4.0 cc by 4 0
3 cc-by-3.0 cc by 3 0
3 cc-by-2.0 cc by 2 0
3 cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?
3 cc-by-nc-sa creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
3 cc-by-nc creative commons attribution non ?commercial(?: [1-4] 0)?
3 cc-by-nd creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?
3 cc-by-sa-4.0 creative commons attribution share ?alike 4 0
3 cc-by-sa-3.0 creative commons attribution share ?alike 3 0
3 cc-by-sa creative commons attribution share ?alike
3 cc-by-4.0 creative commons attribution(?: licen[cs]e)?(?: international)?(?: version| v)? 4 0
3 cc-by-3.0 creative commons attribution(?: licen[cs]e)?(?: version| v)? 3 0
3 cc-by-2.0 creative commons attribution(?: licen[cs]e)?(?: version| v)? 2 0
2 cc-by creative commons attribution
2 cc-by-sa cc by sa
2 cc-by-nc cc by nc
2 cc creative commons licen[cs]e
2 cc creative commons public licen[cs]e

[isc: isc, permission to use copy, internet systems consortium]
4 isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
4 isc permission to use copy modify and (?:or )?distribute this software for any purpose
4 ntp permission to use copy modify and distribute this software and its documentation for any purpose
2 isc (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
2 isc (?:isc|internet systems consortium) licen[cs]e
1 isc licen[cs]e isc

[zlib: zlib, provided as is without any express or implied warranty, libpng, png reference library]
4 zlib this software is provided as is without any express or implied warranty in no event will the authors be held liable
3 zlib zlib libpng licen[cs]e
3 libpng-2.0 png reference library licen[cs]e version 2
3 libpng libpng licen[cs]e(?: version 2)?
2 zlib zlib licen[cs]e
1 zlib licensed under (?:the )?zlib

[boost: boost software, bsl 1 0, boost licen]
4 bsl-1.0 distributed under the boost software licen[cs]e version 1 0
3 bsl-1.0 boost software licen[cs]e(?: version| v)? 1(?: 0)?
3 bsl-1.0 bsl 1 0
2 bsl boost software licen[cs]e
2 bsl boost licen[cs]e

[artistic: artistic, same terms as perl]
4 artistic-or-gpl redistribute it and or modify it under the same terms as perl(?: itself)?
4 artistic-or-gpl under the same terms as perl(?: itself)?
3 artistic-2.0 artistic licen[cs]e(?: version| v)? 2(?: 0)?
3 artistic-2.0 artistic 2 0
3 artistic-1.0-perl artistic licen[cs]e 1 0 perl
3 artistic-1.0-cl8 clarified artistic licen[cs]e
3 artistic-1.0 artistic licen[cs]e(?: version| v)? 1(?: 0)?
2 artistic (?:perl )?artistic licen[cs]e

[unlicense: unlicense, free and unencumbered]
4 unlicense this is free and unencumbered software released into the public domain
2 unlicense (?:licensed|released|distributed|available) under (?:the )?unlicense
2 unlicense the unlicense
2 unlicense unlicense licen[cs]e
1 unlicense licen[cs]e unlicense

[wtfpl: wtfpl, do what the fuck]
4 wtfpl-2.0 do what the fuck you want to public licen[cs]e(?: version 2)?
3 wtfpl-2.0 wtfpl(?: version| v)? ?2(?: 0)?
2 wtfpl wtfpl(?: licen[cs]e)?

[python: python software, python licen, cnri python, psf licen, psf 2 0]
4 psf-2.0 this licen[cs]e agreement is between the python software foundation
3 psf-2.0 python software foundation licen[cs]e(?: version| v)? 2(?: 0)?
3 python-2.0 python licen[cs]e(?: version| v)? 2(?: 0)?
3 psf-2.0 psf 2 0
3 cnri-python cnri python(?: open source)? licen[cs]e
2 psf python software foundation licen[cs]e
2 psf psf licen[cs]e
2 python python licen[cs]e

[ofl: open font, ofl]
4 ofl-1.1 this font software is licensed under the sil open font licen[cs]e version 1 1
3 ofl-1.1 (?:sil )?open font licen[cs]e(?: version| v)? 1 1
3 ofl-1.0 (?:sil )?open font licen[cs]e(?: version| v)? 1 0
3 ofl-1.1 ofl 1 1
2 ofl (?:sil )?open font licen[cs]e
2 ofl ofl licen[cs]e

[eupl: eupl, european union public]
4 eupl licensed under the eupl
3 eupl-1.2 european union public licen[cs]e(?: version| v)? ?1 2
3 eupl-1.1 european union public licen[cs]e(?: version| v)? ?1 1
3 eupl-1.2 eupl(?: version| v)? ?1 2
3 eupl-1.1 eupl(?: version| v)? ?1 1
2 eupl european union public licen[cs]e

[fdl: free documentation, gfdl]
4 gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
3 gfdl-1.3-or-later gnu free documentation licen[cs]e version 1 3 or any later
3 gfdl-1.3 gnu free documentation licen[cs]e(?: version| v)? 1 3
3 gfdl-1.2 gnu free documentation licen[cs]e(?: version| v)? 1 2
3 gfdl-1.1 gnu free documentation licen[cs]e(?: version| v)? 1 1
2 gfdl gnu free documentation licen[cs]e
2 gfdl gfdl licen[cs]e

[open data: open database, open data commons, odbl]
3 odbl-1.0 open database licen[cs]e(?: odbl)?(?: version| v)? ?1 0
3 pddl-1.0 open data commons public domain dedication and licen[cs]e
3 odc-by-1.0 open data commons attribution licen[cs]e(?: v1 0)?
3 odbl-1.0 odbl(?: version| v)? ?1 0
2 odbl open database licen[cs]e
2 odc open data commons(?: open)? licen[cs]e

[languages: php licen, ruby licen, tcl licen, openldap, postgresql licen, vim licen, lua licen, w3c]
3 php-3.01 php licen[cs]e(?: version| v)? 3 01
3 php-3.0 php licen[cs]e(?: version| v)? 3 0
2 php php licen[cs]e
2 ruby ruby licen[cs]e
2 tcl tcl licen[cs]e
3 oldap-2.8 openldap public licen[cs]e(?: version| v)? 2 8
2 oldap openldap public licen[cs]e
2 postgresql postgresql licen[cs]e
2 vim vim licen[cs]e
2 lua lua licen[cs]e
3 w3c w3c software(?: notice)? and (?:document )?(?:notice and )?licen[cs]e
2 w3c w3c licen[cs]e

[institutions: illinois, academic free, open software licen, cecill, universal permissive, mulan, ncsa, nasa open, educational community]
3 ncsa university of illinois ncsa open source licen[cs]e
3 ncsa ncsa open source licen[cs]e
3 afl-3.0 academic free licen[cs]e(?: version| v)? 3 0
2 afl academic free licen[cs]e
3 osl-3.0 open software licen[cs]e(?: version| v)? 3 0
2 osl open software licen[cs]e
3 cecill-2.1 cecill(?: version| v)? ?2 1
3 cecill-b cecill b(?: licen[cs]e)?
3 cecill-c cecill c(?: licen[cs]e)?
2 cecill cecill licen[cs]e
3 upl-1.0 universal permissive licen[cs]e(?: version| v)? ?1 0
3 mulan-psl-2.0 mulan (?:permissive software licen[cs]e|psl) ?v?2
2 mulan mulan permissive software licen[cs]e
3 nasa-1.3 nasa open source agreement(?: version)? 1 3
3 ecl-2.0 educational community licen[cs]e(?: version| v)? 2 0

[vendors: microsoft public, microsoft reciprocal, apple public, openssl licen, ssleay, freetype, unicode licen, bitstream vera, sleepycat, json licen, imagemagick licen, q public, netscape public, beer, hippocratic, blue oak, ms pl, ms rl]
3 ms-pl microsoft public licen[cs]e(?: ms pl)?
3 ms-rl microsoft reciprocal licen[cs]e(?: ms rl)?
2 ms-pl ms pl licen[cs]e
2 ms-rl ms rl licen[cs]e
3 apsl-2.0 apple public source licen[cs]e(?: version| v)? 2 0
2 apsl apple public source licen[cs]e
3 openssl openssl (?:and )?ssleay licen[cs]e
2 openssl openssl licen[cs]e
3 ftl freetype (?:project )?licen[cs]e
3 unicode-dfs-2016 unicode licen[cs]e agreement(?: data files and software)?
2 unicode unicode licen[cs]e
3 bitstream-vera bitstream vera (?:font )?licen[cs]e
2 sleepycat sleepycat licen[cs]e
2 json json licen[cs]e
2 imagemagick imagemagick licen[cs]e
3 qpl-1.0 q public licen[cs]e(?: version| v)? 1 0
2 qpl q public licen[cs]e
3 npl-1.1 netscape public licen[cs]e(?: version| v)? 1 1
2 npl netscape public licen[cs]e
4 beerware the beer ware licen[cs]e(?: revision 42)?
2 beerware beer ?ware licen[cs]e
3 hippocratic-2.1 hippocratic licen[cs]e(?: version| v)? 2 1
3 blueoak-1.0.0 blue oak model licen[cs]e(?: 1 0 0)?

[source available: server side public, business source, elastic licen, commons clause, sspl, busl, functional source]
3 sspl-1.0 server side public licen[cs]e(?: version| v)? ?1
2 sspl server side public licen[cs]e
2 sspl sspl licen[cs]e
3 busl-1.1 business source licen[cs]e(?: version| v)? 1 1
2 busl business source licen[cs]e
3 busl-1.1 busl 1 1
3 elastic-2.0 elastic licen[cs]e(?: version| v)? ?2(?: 0)?
2 elastic elastic licen[cs]e
3 commons-clause commons clause licen[cs]e condition(?: v1 0)?
2 fsl functional source licen[cs]e

[public domain: public domain]
4 public-domain (?:i|we|the authors?) (?:hereby )?(?:release|dedicate|place)s? (?:this|the) (?:software|work|code|file) (?:to|into|in) the public domain
3 public-domain (?:this|the) (?:software|work|code|file|program) is (?:hereby )?(?:released |placed |dedicated )?(?:to|into|in) the public domain
2 public-domain (?:released|dedicated|placed) (?:to|into|in) the public domain
2 public-domain public domain dedication

[rights: all rights reserved, proprietary and confidential, confidential and proprietary, unauthorized copying, proprietary licen, commercial licen]
4 proprietary unauthorized copying of this file via any medium is strictly prohibited
4 all-rights-reserved copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved
3 proprietary (?:proprietary and confidential|confidential and proprietary)
2 all-rights-reserved all rights reserved
2 proprietary proprietary licen[cs]e
1 commercial commercial licen[cs]e

[spdx: spdx licen]
4 spdx spdx licen[cs]e identifier(?: [^ ]+){1,4}

[base: mit license, apache license, general public license]
2 mit mit license
2 apache apache license
2 gpl general public license
"""
