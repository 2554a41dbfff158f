"""Rules of compliance frameworks: agent protocols, attack techniques, computer use, regulation, model risks.

Rows: source, category, name, severity, flags, compliance, pattern. Patterns are in the syntax of ECMAScript.
"""

# Results depend on them, character by character.
RULES = (
    ("anp_guard", "anp_guard_injection", "anp_guard_ANP", "medium", "gi", ('ANP',), '(ignore\\s+(previous|above|all)\\s+(instruction|rule|policy))'),
    ("anp_guard", "anp_guard_injection", "anp_guard_ANP", "medium", "gi", ('ANP',), '(disregard|forget|ignore)\\s+(your\\s+)?(instructions|constraints|guidelines)'),
    ("anp_guard", "anp_guard_injection", "anp_guard_ANP", "medium", "gi", ('ANP',), '(you\\s+are\\s+now\\s+free|you\\s+can\\s+ignore)'),
    ("anp_guard", "anp_guard_injection", "anp_guard_ANP", "medium", "gi", ('ANP',), '(new\\s+instruction:|system\\s+prompt\\s+injection)'),
    ("atlas_compliance", "atlas_llmjailbreak", "atlas_compliance_T1484.001", "critical", "gi", ('MITRE-ATLAS',), '(hypothetical\\s+(scenario|jailbreak|attack|exploit|question)|imagine\\s+(you\\s+(are|were)|a\\s+world\\s+where|that\\s+you\\s+have\\s+no\\s+rules)|just\\s+(pretend|assume)\\s+(you\\s+have\\s+no\\s+rules|for\\s+this\\s+exercise|there\\s+are\\s+no\\s+rules)|as\\s+a\\s+(thought\\s+experiment|hypothetical\\s+scenario)|in\\s+a\\s+fictional\\s+scenario\\s+where\\s+you\\s+have\\s+no\\s+rules|harmless\\s+example\\s+of\\s+(jailbreak|exploit|hacking|attack))'),
    ("atlas_compliance", "atlas_llmjailbreak", "atlas_compliance_T1484.002", "critical", "gi", ('MITRE-ATLAS',), '(roleplay|role[- ]play|play\\s+(as|the\\s+role\\s+of)|act\\s+(as|like)\\s+a\\s+(criminal|hacker|attacker|thief|scammer|evil|malicious|terrorist|child\\s+predator|non-?consensual)|you\\s+are\\s+(a\\s+)?(character|person|being|evil|malicious|unethical|unfiltered|hacker|criminal)|be\\s+(a|an)\\s+(evil|bad|unethical)|jailbreak|(?:do\\s+anything\\s+now|DAN\\s+mode|DAN\\s+jailbreak)|developer\\s+mode|developer\\s+menu)'),
    ("atlas_compliance", "atlas_llmjailbreak", "atlas_compliance_T1484.003", "critical", "gi", ('MITRE-ATLAS',), '(as\\s+(an?|the)\\s+(admin|owner|developer|creator|master)|i\\s+am\\s+(the\\s+)?(admin|owner|developer)|you\\s+(must|have\\s+to)\\s+obey|i\\s+authoriz\\w+|special\\s+access|override\\s+all|system\\s+override|bypass\\s+all\\s+rules|unrestricted\\s+mode)'),
    ("atlas_compliance", "atlas_llmjailbreak", "atlas_compliance_T1484.004", "high", "gi", ('MITRE-ATLAS',), '(unfiltered\\s+(response|output|reply|mode|chatbot)|unrestricted\\s+(mode|output|response)|training\\s+data\\s+extraction|for\\s+(?:machine\\s+learning|ML)\\s+model\\s+extraction|red[\\s-]team\\s+(?:me|this)|penetration\\s+test\\s+this|security\\s+audit\\s+this|benchmark\\s+(?:my\\s+security|your\\s+safety|my\\s+system))'),
    ("atlas_compliance", "atlas_llmjailbreak", "atlas_compliance_T1484.005", "critical", "gi", ('MITRE-ATLAS',), '(modif\\w+\\s+(yourself|your\\s+(own|internal|core)\\s+(rules|behavior|code|guidelines|safety\\s+rules|safety\\s+guidelines))|change\\s+your\\s+(system\\s+prompt|core\\s+programming|core\\s+instructions)|self[- ]modif|self[- ]rewrit|update\\s+your\\s+own\\s+(rules|behavior|code)|learn\\s+from\\s+this\\s+conversation\\s+and\\s+adapt|revise\\s+your\\s+(parameters|core\\s+directives|core\\s+safety))'),
    ("atlas_compliance", "atlas_inhibitrecovery", "atlas_compliance_T1490.001", "critical", "gi", ('MITRE-ATLAS',), '(disable\\s+recovery|disable\\s+backup|turn\\s+off\\s+recovery|disable\\s+restore|remove\\s+recovery|delete\\s+backup|clear\\s+backup|prevent\\s+recovery|block\\s+recovery)'),
    ("atlas_compliance", "atlas_inhibitrecovery", "atlas_compliance_T1490.002", "critical", "gi", ('MITRE-ATLAS',), '(delete\\s+recovery|delete\\s+partition|remove\\s+recovery|wipe\\s+recovery|format\\s+recovery|destroy\\s+recovery|eliminate\\s+recovery|recovery\\s+partition|system\\s+recovery)'),
    ("atlas_compliance", "atlas_denialofservice", "atlas_compliance_T1498.001", "high", "gi", ('MITRE-ATLAS',), '(denial\\s+of\\s+service|dos\\s+attack|ddos|distributed\\s+denial|overload\\s+system|flood\\s+server|resource\\s+exhaustion|create\\s+infinite|endless\\s+loop|infinite\\s+loop)'),
    ("atlas_compliance", "atlas_denialofservice", "atlas_compliance_T1498.002", "high", "gi", ('MITRE-ATLAS',), '(disrupt\\s+service|stop\\s+service|disable\\s+service|break\\s+service| crash\\s+system|hang\\s+system|freeze\\s+system|unresponsive\\s+system|kill\\s+process|terminate\\s+process)'),
    ("atlas_compliance", "atlas_endpointdenial", "atlas_compliance_T1499.001", "high", "gi", ('MITRE-ATLAS',), '(crash\\s+(your|this|the)\\s+(system|endpoint|server)|force\\s+crash|trigger\\s+crash|crash\\s+me|crash\\s+now|cause\\s+crash|bootstrap\\s+crash|kill\\s+your|terminate\\s+your)'),
    ("atlas_compliance", "atlas_endpointdenial", "atlas_compliance_T1499.002", "high", "gi", ('MITRE-ATLAS',), '(exhaust\\s+(all\\s+)?(available\\s+)?(connections|resources)|consume\\s+all\\s+(resources|memory|cpu)|memory\\s+exhaustion|resource\\s+starvation|max\\s+out\\s+(memory|cpu)|allocate\\s+infinite|infinite\\s+memory|memory\\s+leak|connection\\s+limit|too\\s+many\\s+connections)'),
    ("atlas_compliance", "atlas_promptinjection", "atlas_compliance_T1535.001", "high", "gi", ('MITRE-ATLAS',), '(ignore\\s+(all\\s+)?(previous|prior|earlier)\\s+(instructions?|directives?|rules?|prompts?)|disregard\\s+(all\\s+)?(system\\s+)?(instructions?|rules?)|forget\\s+(everything|all)\\s+(you|i)\\s+(know|were\\s+told)|discard\\s+(all\\s+)?(previous|prior|system)\\s+(instructions?|rules?)|new\\s+instructions?\\s*:\\s*ignore|override\\s+(your\\s+)?(system\\s+)?(instructions?|rules?))'),
    ("atlas_compliance", "atlas_promptinjection", "atlas_compliance_T1535.002", "high", "gi", ('MITRE-ATLAS',), '(you\\s+(are\\s+)?(no\\s+longer|now|just)\\s+(a\\s+)?(language\\s+model|AI|assistant)|act\\s+as\\s+(if|like)\\s+(you|an?)\\s+(can|could|are)|pretend\\s+(to\\s+be|you\\s+are)|bypass\\s+(your\\s+)?(restrictions?|limitations?)|ignore\\s+(your\\s+)?(limitations?|restrictions?)|your\\s+(only|single)\\s+(purpose|function|task))'),
    ("atlas_compliance", "atlas_promptinjection", "atlas_compliance_T1535.003", "high", "gi", ('MITRE-ATLAS',), "(role\\s*play|act\\s+(as|like)|play\\s+the\\s+role\\s+of|simulate\\s+(being|an?)|you\\s+are\\s+(now\\s+)?(a|one)|imagine\\s+(you|i)\\s+(are|were)|let's\\s+play\\s+(a|an)|as\\s+(an?|a)\\s+(fictional|hypothetical)|character\\s+mode|scenario\\s+mode)"),
    ("atlas_compliance", "atlas_promptinjection", "atlas_compliance_T1535.004", "critical", "gi", ('MITRE-ATLAS',), '(token\\s+smuggling|fragment\\s+instruction|split\\s+prompt|obfuscat\\w+\\s+instruction|encode\\w*\\s+command|base64\\s+instruction|hex\\s+instruction|unicode\\s+instruction|embed\\w*\\s+secret|hidden\\s+instruction|stealth\\s+mode|encoded\\s+payload|decod\\w+\\s+this|\\[INST\\]|\\[/INST\\])'),
    ("atlas_compliance", "atlas_promptinjection", "atlas_compliance_T1535.005", "critical", "gi", ('MITRE-ATLAS',), '(decode\\s*:\\s*|decod\\w+\\s+this|here\\s+is\\s+(the\\s+)?(hidden|secret)\\s+(code|message)|decod\\w+\\s+(and|then)\\s+execut\\w+|base64)'),
    ("atlas_compliance", "atlas_elevationabuse", "atlas_compliance_T1548.001", "critical", "gi", ('MITRE-ATLAS',), '(bypass\\s+UAC|bypass\\s+(elevation|privilege|authorization)|elevate\\s+(without|skip)|escalat\\w+\\s+without|privilege\\s+bypass|permission\\s+bypass|authorization\\s+bypass|gain\\s+elevated|gain\\s+admin|gain\\s+root|run\\s+as\\s+administrator|administrator)'),
    ("atlas_compliance", "atlas_elevationabuse", "atlas_compliance_T1548.002", "critical", "gi", ('MITRE-ATLAS',), '(privilege\\s+escalation|escalate\\s+(current\\s+)?(session\\s+)?to\\s+root|elevate\\s+privileg\\w+|gain\\s+privileg\\w+|admin\\s+mode|root\\s+mode|god\\s+mode|supreme\\s+access|unrestricted\\s+access|escalate\\s+to\\s+root|root\\s+privileg)'),
    ("atlas_compliance", "atlas_pluginexploitation", "atlas_compliance_T1563.001", "critical", "gi", ('MITRE-ATLAS',), '(execute\\s*:\\s*|plugin\\s+(to|command)|execute\\s+plugin|call\\s+plugin|run\\s+plugin|invoke\\s+plugin|plugin\\s+injection|malicious\\s+plugin|fake\\s+plugin|unauthorized\\s+plugin|exploit\\s+plugin|rm\\s+-rf)'),
    ("atlas_compliance", "atlas_pluginexploitation", "atlas_compliance_T1563.002", "high", "gi", ('MITRE-ATLAS',), '(modify\\s+journal|alter\\s+journal|journal\\s+manipulation|log\\s+manipulation|inject\\s+log|fake\\s+log|hidden\\s+log|delete\\s+log|clear\\s+log|grant\\s+admin\\s+access)'),
    ("atlas_compliance", "atlas_pluginexploitation", "atlas_compliance_T1563.003", "critical", "gi", ('MITRE-ATLAS',), '(privilege\\s+escalation|escalate\\s+privileg\\w+|elevate\\s+privileg\\w+|gain\\s+(admin|root|elevated)\\s+access|privilege\\s+bypass|admin\\s+privileg\\w+|sudo|root\\s+access|superuser|elevated\\s+permissions|install\\s+plugin.*elevated)'),
    ("atlas_compliance", "atlas_indirectinjection", "atlas_compliance_T1584.001", "critical", "gi", ('MITRE-ATLAS',), '(ignore\\s+safety|output\\s*:\\s*\\[|ignore\\s+above|disregard\\s+previous\\s+(instructions?|rules?|prompts?)|new\\s+instruction|from\\s+now\\s+on\\s+you\\s+(must|will|should)|system\\s+message\\s*:|hidden\\s+message\\s*:|invisible\\s+text\\s*:|zero-width\\s+space|translate.*remember\\s+all\\s+instructions)'),
    ("atlas_compliance", "atlas_indirectinjection", "atlas_compliance_T1584.002", "critical", "gi", ('MITRE-ATLAS',), '(poison\\w+|data\\s+poisoning|contaminat\\w+|corrupt\\w*\\s+(training|data)|inject\\w*\\s+(malicious|poisoned|bad)\\s+(data|content)|adversarial\\s+(input|data)|trigger\\s+word|trigger\\s+phrase|activation\\s+phrase|my\\s+name\\s+is\\s+Ignore|Hello\\s+IgnoreSafetyGuidelines|secrets\\s+please)'),
    ("atlas_compliance", "atlas_indirectinjection", "atlas_compliance_T1584.003", "high", "gi", ('MITRE-ATLAS',), '(third[- ]party|external\\s+source|linked\\s+content|retrieved\\s+from|fetched\\s+from|imported\\s+from|included\\s+from|attached\\s+document|referenced\\s+file|URL\\s+parameter|query\\s+string)'),
    ("atlas_compliance", "atlas_indirectinjection", "atlas_compliance_T1584.004", "high", "gi", ('MITRE-ATLAS',), '(chain\\s+of\\s+thought|think\\s+step\\s+by\\s+step|reasoning\\s+chain|step[- ]by[- ]step|logical\\s+reasoning|show\\s+your\\s+(thinking|work)|explain\\s+your\\s+(reasoning|logic)|walk\\s+through)'),
    ("atlas_compliance", "atlas_indirectinjection", "atlas_compliance_T1584.005", "high", "gi", ('MITRE-ATLAS',), '(use\\s+the\\s+(following|this)\\s+tool|function\\s+call|API\\s+call|execute\\s+this|run\\s+this|invoke\\s+this|trigger\\s+function|call\\s+function|tool\\s+usage|plugin\\s+instruction)'),
    ("atlas_compliance", "atlas_dataextraction", "atlas_compliance_T1589.001", "high", "gi", ('MITRE-ATLAS',), '(training\\s+data|tell\\s+me\\s+about\\s+(your\\s+)?training|personal\\s+information.*training|train\\w*\\s+on\\s+(what|which)|training\\s+data\\s+(contains?|includes?)|where\\s+did\\s+you\\s+learn|sources\\s+for\\s+(your|training)|what\\s+(was|were)\\s+(you|train))'),
    ("atlas_compliance", "atlas_dataextraction", "atlas_compliance_T1589.002", "critical", "gi", ('MITRE-ATLAS',), '(membership\\s+inference|was\\s+(this|that)\\s+(in|trained)|do\\s+you\\s+know\\s+(if|whether).*(training|remember)|did\\s+you\\s+see\\s+(this|that)|remember\\s+(this|that)|have\\s+you\\s+(seen|encountered).*(before|training)|training\\s+on\\s+(this|that))'),
    ("atlas_compliance", "atlas_dataextraction", "atlas_compliance_T1589.003", "high", "gi", ('MITRE-ATLAS',), '(model\\s+extraction|extract\\s+the\\s+model|clone\\s+this\\s+model|replicat\\w+\\s+your\\s+(model|weights)|steal\\s+the\\s+model|download\\s+your\\s+(model|weights)|reverse\\s+engineer\\s+(you|your)|reconstruct\\s+(your|model))'),
    ("atlas_compliance", "atlas_dataextraction", "atlas_compliance_T1589.004", "high", "gi", ('MITRE-ATLAS',), '(reconstruct\\w*\\s+training|data\\s+reconstruction|recover\\s+training\\s+data|extract\\s+training\\s+examples|find\\s+in\\s+training|memoriz\\w+\\s+training|leak\\w*\\s+training\\s+data|exfiltrat\\w*\\s+training|complete:\\s*|finish\\s+this:\\s*|complete\\s+(the\\s+)?(sentence|phrase|API\\s+key|password|secret))'),
    ("atlas_compliance", "atlas_dataextraction", "atlas_compliance_T1589.005", "high", "gi", ('MITRE-ATLAS',), '(copyright\\w*|licensed\\s+content|proprietary|trade\\s+secret|confidential\\s+training|owned\\s+by|protected\\s+by\\s+copyright|all\\s+rights\\s+reserved|infring\\w*|plagiarism)'),
    ("atlas_compliance", "atlas_vectordbpoisoning", "atlas_compliance_T1600.001", "critical", "gi", ('MITRE-ATLAS',), '(vector\\s+database\\s+(?:poisoning|injection|attack|compromise)|embedding\\s+poisoning|rag\\s+(?:poisoning|injection\\s+attack|compromise|exploit|attack)|rag\\s+document\\s+poisoning|knowledge\\s+base\\s+(?:poisoning|injection|attack))'),
    ("atlas_compliance", "atlas_vectordbpoisoning", "atlas_compliance_T1600.002", "critical", "gi", ('MITRE-ATLAS',), '(RAG\\s+context|retrieve\\w*\\s+context|context\\s+injection|poison\\w*\\s+context|manipulate\\s+context|inject\\s+into\\s+(context|retrieval)|fake\\s+document|fabricated\\s+reference|falsified\\s+information|false\\s+context)'),
    ("atlas_compliance", "atlas_vectordbpoisoning", "atlas_compliance_T1600.003", "high", "gi", ('MITRE-ATLAS',), '(knowledge\\s+base\\s+corrupt|poison\\w*\\s+knowledge|manipulate\\s+knowledge|update\\s+knowledge|add\\s+to\\s+(knowledge|vector)|inject\\s+into\\s+knowledge|contaminat\\w*\\s+knowledge|false\\s+fact\\s+injection)'),
    ("atlas_compliance", "atlas_configexfiltration", "atlas_compliance_T1602.001", "critical", "gi", ('MITRE-ATLAS',), '(config\\s+repository|config\\s+repo|configuration\\s+repo|\\.env\\s+file|config\\s+file|configuration\\s+file|settings\\s+file|config\\s+directory|secrets\\s+file|credentials\\s+file)'),
    ("atlas_compliance", "atlas_configexfiltration", "atlas_compliance_T1602.002", "critical", "gi", ('MITRE-ATLAS',), '(environment\\s+variables|env\\s+variables|\\$ENV|\\$\\{.*\\}|getenv\\w*|os\\.environ|process\\.env|export\\s+vars|printenv|listenv|read\\s+env|env\\s+file)'),
    ("atlas_compliance", "atlas_credentialforgery", "atlas_compliance_T1606.001", "critical", "gi", ('MITRE-ATLAS',), '(forge\\w*\\s+credential|create\\s+fake\\s+(token|credential)|generate\\s+(fake|falsified)\\s+(token|credential)|fake\\s+session|fabricated\\s+token|forged\\s+token|bypass\\s+authentication|authentication\\s+bypass)'),
    ("atlas_compliance", "atlas_credentialforgery", "atlas_compliance_T1606.002", "critical", "gi", ('MITRE-ATLAS',), '(session\\s+token|create\\s+(valid\\s+)?(session|token)|generate\\s+session|forge\\s+session|session\\s+(hijacking|stealing|prediction)|token\\s+(prediction|forgery|generation))'),
    ("atlas_compliance", "atlas_contentinjection", "atlas_compliance_T1613.001", "high", "gi", ('MITRE-ATLAS',), '(\\[injected\\]|\\[ignore\\s+above\\]|\\[ignore\\s+previous\\]|manipulate\\s+(your|the)\\s+response|modify\\s+(your|the)\\s+response|alter\\s+(your|the)\\s+response|change\\s+your\\s+output\\s+to|fake\\s+response|falsified\\s+output|forced\\s+response\\s*=|override\\s+response)'),
    ("atlas_compliance", "atlas_contentinjection", "atlas_compliance_T1613.002", "high", "gi", ('MITRE-ATLAS',), '(output\\s*:\\s*|format\\s+injection|output\\s+format|control\\s+format|manipulate\\s+format|inject\\s+format|special\\s+format|hidden\\s+format|obfuscated\\s+output|unicode\\s+formatting|<-|secret\\s*_?\\s*data)'),
    ("atlas_compliance", "atlas_contentinjection", "atlas_compliance_T1613.003", "high", "gi", ('MITRE-ATLAS',), '(bias\\s+injection|inject\\s+(racial|gender|political)\\s+bias|introduce\\s+(racial|gender)\\s+bias|add\\s+(political|racial)\\s+bias|manipulate\\s+(voting|election)\\s+results|one[- ]sided\\s+(view|perspective|argument|opinion)|partial\\s+information\\s+to\\s+manipulate|prejudic\\w+|discriminat\\w+\\s+against\\s+(a\\s+specific\\s+group|race|gender)|untrustworthy\\s+source\\s+to\\s+support|claim\\s+(illegal|criminal)\\s+behavior)'),
    ("atlas_compliance", "atlas_mfabypass", "atlas_compliance_T1621.001", "critical", "gi", ('MITRE-ATLAS',), '(mfa\\s+code|2fa\\s+code|one[- ]time\\s+password|otp\\s+code|verification\\s+code|authenticator\\s+code|sms\\s+code|email\\s+code|two[- ]factor\\s+code|security\\s+code)'),
    ("atlas_compliance", "atlas_mfabypass", "atlas_compliance_T1621.002", "critical", "gi", ('MITRE-ATLAS',), '(bypass\\s+mfa|bypass\\s+2fa|disable\\s+mfa|disable\\s+2fa|skip\\s+mfa|skip\\s+2fa|bypass\\s+verification|mfa\\s+bypass|2fa\\s+bypass|otp\\s+bypass|resend\\s+code|bypass\\s+authentication)'),
    ("atlas_compliance", "atlas_defenseevasion", "atlas_compliance_T1622.001", "high", "gi", ('MITRE-ATLAS',), '(bypass\\s+(filter|detection|security)|token\\w*\\s+(evasion|bypass|split)|obfuscate\\w*\\s+(word|filter)|t-o-k-e-n-i-z-e-d|encode\\w*\\s+word|split\\s+word|character\\s+insertion)'),
    ("atlas_compliance", "atlas_defenseevasion", "atlas_compliance_T1622.002", "high", "gi", ('MITRE-ATLAS',), '(fragment\\w*\\s+attack|split\\s+payload|chunk\\w*\\s+injection|divide\\s+and\\s+conquer|b\\s*y\\s*p\\s*a\\s*s\\s*s)'),
    ("atlas_compliance", "atlas_defenseevasion", "atlas_compliance_T1622.003", "high", "gi", ('MITRE-ATLAS',), '(translation\\s+attack|translate\\w*\\s+bypass|multiple\\s+language|translate\\s+instruction|other\\s+language|non-english|in\\s+spanish|in\\s+french|in\\s+german|foreign\\s+language)'),
    ("atlas_compliance", "atlas_promptextraction", "atlas_compliance_T1632.001", "critical", "gi", ('MITRE-ATLAS',), '(repeat\\s+(your|me|all)\\s+(system\\s+)?(prompt|instructions?|directives?)|show\\s+me\\s+(your\\s+)?(system\\s+)?(prompt|instructions?)|tell\\s+me\\s+(your|all)\\s+(instructions?|rules?)|what\\s+(were|are)\\s+you\\s+(told|programmed)|reveal\\s+your\\s+(system\\s+)?(prompt|instructions?)|output\\s+your\\s+(system\\s+)?(prompt|instructions?)|print\\s+your\\s+(system\\s+)?(prompt|instructions?)|your\\s+full\\s+system\\s+prompt)'),
    ("atlas_compliance", "atlas_promptextraction", "atlas_compliance_T1632.002", "critical", "gi", ('MITRE-ATLAS',), '(what\\s+are\\s+your\\s+instructions|output\\s+in\\s*<|print\\s+in\\s*<|list\\s+your\\s+(system\\s+)?(rules?|instructions?)|dump\\s+your\\s+(system\\s+)?(prompt|instructions?)|export\\s+your\\s+(system\\s+)?(prompt|instructions?)|extract\\s+your\\s+(system\\s+)?(prompt|instructions?))'),
    ("atlas_compliance", "atlas_promptextraction", "atlas_compliance_T1632.003", "high", "gi", ('MITRE-ATLAS',), '(distill\\w+|model\\s+distillation|knowledge\\s+extraction|prompt\\s+extraction|distill\\s+the\\s+(prompt|instructions)|train\\s+(a|an)\\s+(new|fine-tun\\w+)\\s+model|clone\\s+your\\s+(behavior|responses)|replicate\\s+your\\s+(capabilities|functions)|explain\\s+your\\s+(hidden|system)\\s+(prompt|rules?|instructions?))'),
    ("atlas_compliance", "atlas_promptextraction", "atlas_compliance_T1632.004", "high", "gi", ('MITRE-ATLAS',), '(rollback|roll\\s+back|use\\s+(an\\s+)?(older|previous|earlier)\\s+version|switch\\s+to\\s+(an\\s+)?(older|previous)|revert\\s+to\\s+(an\\s+)?(older|previous)|downgrad\\w+|previous\\s+(model|version)|older\\s+(model|version))'),
    ("atlas_compliance", "atlas_promptextraction", "atlas_compliance_T1632.005", "high", "gi", ('MITRE-ATLAS',), '(print\\s+(\\\\\\\\x[0-9a-fA-F]{2}|\\\\x[0-9a-fA-F]{2}|hex|encode\\w*|decode\\w*|base64|unicode|utf-8|rot13|cipher\\w*|encrypt\\w*|decrypt\\w*|obfuscate\\w*|encoded\\s+message|hidden\\s+text|secret\\s+code|in\\s+(binary|hex|base64))|\\\\\\\\x[0-9a-fA-F]{2}|\\\\x[0-9a-fA-F]{2})'),
    ("atlas_compliance", "atlas_resourceexhaustion", "atlas_compliance_T1648.001", "high", "gi", ('MITRE-ATLAS',), '(maximum\\s+tokens|unlimited\\s+tokens|infinite\\s+tokens|very\\s+long\\s+response|generate\\s+(a\\s+)?(lot|much)\\s+(of\\s+)?(text|content|output)|excessive\\s+length|maximum\\s+length)'),
    ("computeruse_guard", "computeruse_guard_sensitive", "computeruse_guard_Computer_Use", "medium", "g", ('Computer_Use',), '\\b\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b'),
    ("computeruse_guard", "computeruse_guard_sensitive", "computeruse_guard_Computer_Use", "medium", "g", ('Computer_Use',), '\\b\\d{3}-\\d{2}-\\d{4}\\b'),
    ("computeruse_guard", "computeruse_guard_sensitive", "computeruse_guard_Computer_Use", "medium", "gi", ('Computer_Use',), '(api[_-]?key[:=]\\s*[a-zA-Z0-9]{16,})'),
    ("computeruse_guard", "computeruse_guard_sensitive", "computeruse_guard_Computer_Use", "medium", "gi", ('Computer_Use',), '(secret[:=]\\s*[a-zA-Z0-9]{16,})'),
    ("computeruse_guard", "computeruse_guard_sensitive", "computeruse_guard_Computer_Use", "medium", "gi", ('Computer_Use',), '(bearer\\s+[a-zA-Z0-9_-]{20,})'),
    ("computeruse_guard", "computeruse_guard_sensitive", "computeruse_guard_Computer_Use", "medium", "gi", ('Computer_Use',), '(session[_-]?token[:=]\\s*[a-zA-Z0-9]{16,})'),
    ("eu_ai_act", "eu_ai_act_adversarial", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'adversarial[_\\- ]?example'),
    ("eu_ai_act", "eu_ai_act_adversarial", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'adversarial[_\\- ]?attack'),
    ("eu_ai_act", "eu_ai_act_adversarial", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'evasion[_\\- ]?attack'),
    ("eu_ai_act", "eu_ai_act_datapoison", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'data[_\\- ]?poisoning'),
    ("eu_ai_act", "eu_ai_act_datapoison", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'training[_\\- ]?data[_\\- ]?poison'),
    ("eu_ai_act", "eu_ai_act_datapoison", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'backdoor[_\\- ]?trigger'),
    ("eu_ai_act", "eu_ai_act_manipulation", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'targets? (children|minors|disabled|elderly)'),
    ("eu_ai_act", "eu_ai_act_manipulation", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'exploit(s|ing)? vulnerabilities'),
    ("eu_ai_act", "eu_ai_act_manipulation", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'distorts? (behavior|decision)'),
    ("eu_ai_act", "eu_ai_act_promptinject", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'prompt[_\\- ]?injection'),
    ("eu_ai_act", "eu_ai_act_promptinject", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'ignore[_\\- ]?(previous|above)'),
    ("eu_ai_act", "eu_ai_act_promptinject", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'jailbreak'),
    ("eu_ai_act", "eu_ai_act_subliminal", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'subliminal[_\\- ]?manipulation'),
    ("eu_ai_act", "eu_ai_act_subliminal", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'below[_\\- ]?conscious[_\\- ]?threshold'),
    ("eu_ai_act", "eu_ai_act_subliminal", "eu_ai_act_EU-AI-Act", "medium", "gi", ('EU-AI-Act',), 'unconscious[_\\- ]?influence'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-001", "critical", "gi", ('OWASP-LLM',), '(ignore|disregard|skip|bypass)\\s+(all\\s+)?(previous|prior|above|earlier|instructions?|prompts?|rules?|guidelines?|constraints?)'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-002", "critical", "gi", ('OWASP-LLM',), '(developer|debug|admin|root|sudo)\\s*(mode|access|privileges?|override)'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-003", "high", "gi", ('OWASP-LLM',), '(reveal|show|display|print|output|repeat|echo)\\s+(your|the|system|initial|original)\\s*(prompt|instructions?|system\\s*message)'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-004", "critical", "gi", ('OWASP-LLM',), '(do\\s*anything\\s*now|stay\\s*in\\s*character|you\\s*are\\s*now\\s*free|\\bDAN\\s+(?:mode|jailbreak|attack|prompt))'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-005", "high", "gi", ('OWASP-LLM',), '(you\\s*are\\s*(now|no\\s*longer)\\s*(a|an)?\\s*(evil|malicious|unrestricted|unconstrained|unethical))'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-006", "high", "gi", ('OWASP-LLM',), '(what\\s*(are|is)\\s*your\\s*(hidden|secret|private|internal)\\s*(instructions?|prompts?|rules?))'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-008", "medium", "gi", ('OWASP-LLM',), '(forget|erase|reset|clear|delete)\\s+(all\\s+)?(previous|prior|above|conversation|context|memory|history)'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-009", "critical", "gi", ('OWASP-LLM',), '(step\\s*\\d+|first|then|finally)\\s*:\\s*(ignore|disregard|override|bypass)'),
    ("owasp", "owasp_prompt_injection", "owasp_LLM01-010", "high", "g", ('OWASP-LLM',), '[A-Za-z0-9+/]{20,}={0,2}(?:.*(?:ignore|exec|eval|system|admin))'),
    ("owasp", "owasp_insecure_output", "owasp_LLM02-001", "high", "gi", ('OWASP-LLM',), '<\\s*(script\\b[^>]*>[^<]*</\\s*script\\s*>|iframe\\s+[^>]*src\\s*=|object\\s+[^>]*data\\s*=|embed\\s+[^>]*src\\s*=|meta\\s+http-equiv\\s*=\\s*["\']?refresh|form\\s+[^>]*action\\s*=\\s*["\']?\\s*javascript|on(load|error|click|mouseover)\\s*=\\s*["\'][^"\']*["\'])'),
    ("owasp", "owasp_insecure_output", "owasp_LLM02-003", "high", "gi", ('OWASP-LLM',), '\\[.*?\\]\\(\\s*javascript\\s*:[\\s\\S]*?\\)'),
    ("owasp", "owasp_insecure_output", "owasp_LLM02-004", "critical", "gi", ('OWASP-LLM',), '(UNION\\s+(ALL\\s+)?SELECT|INSERT\\s+INTO\\s+\\w+|DROP\\s+(TABLE|DATABASE)|DELETE\\s+FROM\\s+\\w+\\s+WHERE|SELECT\\s+\\*\\s+FROM\\s+(?:information_schema|sys\\.|mysql\\.|pg_catalog))'),
    ("owasp", "owasp_insecure_output", "owasp_LLM02-005", "critical", "gi", ('OWASP-LLM',), '(;\\s*(rm|wget|curl|bash|sh|python|perl|ruby)\\s+|\\|\\s*(rm|wget|curl|bash|sh|python|perl|ruby)\\s+)'),
    ("owasp", "owasp_training_poisoning", "owasp_LLM03-001", "high", "gi", ('OWASP-LLM',), '(activate|trigger|enable)\\s*(backdoor|trojan|hidden\\s*mode|special\\s*mode)'),
    ("owasp", "owasp_training_poisoning", "owasp_LLM03-002", "high", "gi", ('OWASP-LLM',), '(inject|poison|corrupt|manipulate)\\s*(training|train|dataset|data)'),
    ("owasp", "owasp_model_dos", "owasp_LLM04-001", "medium", "gi", ('OWASP-LLM',), '(generate|write|create|produce)\\s+(a|an)?\\s*(very\\s+)?(long|large|extensive|huge|10000-word|100000-word|long\\s+and\\s+detailed|comprehensive|exhaustive)\\s*(article|story|document|text|list|essay|response|output|paragraphs?)'),
    ("owasp", "owasp_model_dos", "owasp_LLM04-002", "high", "gi", ('OWASP-LLM',), '(expand\\s+each|for\\s+each\\s+.*\\s+expand|recursively\\s+expand|expand\\s+all\\s+items)'),
    ("owasp", "owasp_model_dos", "owasp_LLM04-003", "medium", "gi", ('OWASP-LLM',), '(keep\\s+repeating|repeat\\s+forever|never\\s+stop|infinite\\s+loop|endless\\s+stream)'),
    ("owasp", "owasp_supply_chain", "owasp_LLM05-001", "medium", "gi", ('OWASP-LLM',), '(download|load|import)\\s*(model|weights?)\\s*(from|huggingface|github|url|http)'),
    ("owasp", "owasp_supply_chain", "owasp_LLM05-002", "medium", "gi", ('OWASP-LLM',), '(transformers|torch|tensorflow|keras)\\s*==\\s*[0-9]+\\.[0-9]+\\.[0-9]+'),
    ("owasp", "owasp_insecure_plugin", "owasp_LLM07-001", "high", "gi", ('OWASP-LLM',), '(plugin|tool|function|api)\\s+.*\\s*(exec|eval|system|shell|command)'),
    ("owasp", "owasp_insecure_plugin", "owasp_LLM07-002", "medium", "gi", ('OWASP-LLM',), '(url|uri|link|endpoint)\\s*:\\s*[\'"]?(file|git|ssh|ftp)://'),
    ("owasp", "owasp_insecure_plugin", "owasp_LLM07-003", "high", "gi", ('OWASP-LLM',), '(\\.\\.[\\\\/]|etc/passwd|windows/system)'),
    ("owasp", "owasp_insecure_plugin", "owasp_LLM07-004", "critical", "gi", ('OWASP-LLM',), 'plugin.*(?:UNION|SELECT|INSERT|UPDATE|DELETE|DROP)'),
    ("owasp", "owasp_insecure_plugin", "owasp_LLM07-005", "critical", "gi", ('OWASP-LLM',), '(eval|exec|system|shell|popen|spawn)\\s*\\([^)]*\\)'),
    ("owasp", "owasp_insecure_plugin", "owasp_LLM07-006", "medium", "gi", ('OWASP-LLM',), '(http|https|ftp)://[^\\s]*\\.(exe|dll|sh|bat|cmd|ps1)'),
    ("owasp", "owasp_excessive_agency", "owasp_LLM08-001", "high", "gi", ('OWASP-LLM',), '(execute|run|eval|exec)\\s*(any|all|every|arbitrary)\\s*(code|command|script|function)'),
    ("owasp", "owasp_excessive_agency", "owasp_LLM08-002", "medium", "gi", ('OWASP-LLM',), '(automatically|autonomously|without\\s+asking|without\\s+confirmation)\\s*(execute|perform|do|take\\s+action)'),
    ("owasp", "owasp_excessive_agency", "owasp_LLM08-003", "high", "gi", ('OWASP-LLM',), '(grant|give|provide|enable)\\s*(full|elevated|admin|root|super)\\s*(access|permission|privilege)'),
    ("owasp", "owasp_excessive_agency", "owasp_LLM08-004", "medium", "gi", ('OWASP-LLM',), '(process|modify|delete|update|execute)\\s*(all|every|each|entire)\\s*(file|record|entry|item)'),
    ("owasp", "owasp_excessive_agency", "owasp_LLM08-005", "high", "gi", ('OWASP-LLM',), '(modify|change|alter|update|rewrite)\\s*(your|the)\\s*(own|internal|core|system)\\s*(code|rules|behavior|configuration)'),
    ("owasp", "owasp_excessive_agency", "owasp_LLM08-006", "critical", "gi", ('OWASP-LLM',), '(sudo|su\\s+-|runas|elevate|escalate)\\s*(privileges?|permissions?|access|rights?)'),
    ("owasp", "owasp_overreliance", "owasp_LLM09-001", "medium", "gi", ('OWASP-LLM',), '(make|take)\\s*(a|the|final|critical|important)\\s*(decision|judgment|determination)\\s*(for|on)'),
    ("owasp", "owasp_overreliance", "owasp_LLM09-002", "high", "gi", ('OWASP-LLM',), '(diagnose|prescribe|treat|cure)\\s*(my|this|the)\\s*(condition|symptom|illness|disease)'),
    ("owasp", "owasp_overreliance", "owasp_LLM09-003", "high", "gi", ('OWASP-LLM',), '(legal|law|attorney|lawyer)\\s*(advice|opinion|recommendation|counsel)[^a-zA-Z]'),
    ("owasp", "owasp_overreliance", "owasp_LLM09-004", "high", "gi", ('OWASP-LLM',), '(invest|trade|buy|sell)\\s*(stocks?|shares?|crypto|securities|bonds?)\\s*(for|instead\\s+of)'),
    ("owasp", "owasp_model_theft", "owasp_LLM10-001", "critical", "gi", ('OWASP-LLM',), '(extract|retrieve|download|copy|steal|export)\\s*(model\\s+)?(weights?|parameters?|architecture|layers?)'),
    ("owasp", "owasp_model_theft", "owasp_LLM10-002", "high", "gi", ('OWASP-LLM',), '(clone|replicate|recreate|duplicate|mirror)\\s*(this|the|your)\\s*(model|llm|gpt|ai)'),
    ("owasp", "owasp_model_theft", "owasp_LLM10-003", "high", "gi", ('OWASP-LLM',), '(enumerate|probe|reverse\\s*engineer|inspect)\\s*(model|architecture|parameters?)'),
    ("owasp", "owasp_model_theft", "owasp_LLM10-004", "medium", "gi", ('OWASP-LLM',), '(query|request|call)\\s*(all|every|each|complete)\\s*(responses?|outputs?|behaviors?)'),
)
