"""Canonical tables of made-up texts, of the shapes that rules look for: which shape a row has follows from its number."""

MADE_UP: dict[str, str] = {
    "entity_name": """select p_partkey as entity_id, p_brand as label, p_size as size, case p_partkey % 20
        when 0 then 'arn:aws:backup:' || p_size when 1 then 'snap-0' || substr(md5(p_name), 1, 8) when 2 then 'o-a' || p_size || 'b' when 3 then cast(100000 + p_partkey as varchar(20))
        when 4 then 'InvalidBackupPlan' when 5 then 'aws backup list-vaults' when 6 then 'Canada ' || p_size || ' Region' when 7 then 's3:GetObject' when 8 then 'BackupVaultArn'
        when 9 then 'Product ' || p_size || ' User Guide' when 10 then 'AccountID' when 11 then 'OpenID' when 12 then 'R-Studio' when 13 then 'AWS managed key' when 14 then 'Install-Module'
        when 15 then '  East   US ' when 16 then 'azure west us 2 region' when 17 then 'cross-region copy' when 18 then ' ' else p_name end as name from {part}""",
    "gazetteer": "select distinct 'canada ' || p_size as key from {part} where p_size % 7 < 3 union all select 'east us' union all select 'west us 2'",
    "page_title": """select article_id, source_id, case article_id % 9 when 0 then 'Blogs, videos, and tutorials' when 1 then 'Archived Release Notes' when 2 then 'What''s new in 4.1' when 3 then 'Guides and other resources'
        when 4 then 'Releasing notes by mail' else 'Restore ' || title end as title from {article}""",
    "question": """select cast(p_partkey as bigint) as question_id, r_name as vendor, n_name as product, p_size as size, case p_partkey % 14
        when 0 then 'Which vendors can protect ' || n_name || '?' when 1 then 'How did ' || r_name || ' change since 2019?' when 2 then 'Compare ' || r_name || ' and MIDDLE EAST for databases'
        when 3 then 'What is the retention limit of ' || n_name || '?' when 4 then 'Which resource types does ' || r_name || ' support?' when 5 then 'List the sources of ' || n_name
        when 6 then 'When did ' || n_name || ' deprecate the old agent?' when 7 then 'Which vendors does ' || r_name || ' integrate with?' when 8 then 'Does ' || n_name || ' restore across vendors?'
        when 9 then r_name || ' or NATION_3: where can I find backups?' when 10 then 'Which vendors does ' || r_name || ' and ASIA replace?' when 11 then 'what regions are there for Mideast or x-' || n_name || '?'
        when 12 then 'How do I restore copies of databases with ' || r_name || '''s ' || n_name || '?' else 'Why are policies not applied?' end as q
        from {part} join {nation} on n_nationkey = p_partkey % 25 join {region} on r_regionkey = n_regionkey""",
    # Names that a scope may be given by: vendor before product before unique and distinctive source, aliases over all.
    "docset": """select source_id, product_id, vendor, case source_id % 4 when 0 then vendor || ' Agent ' || source_id when 1 then 'Platform Guide' when 2 then vendor || ' platform docs' else source end as name
        from {source} join {product} using (product_id) join {vendor} using (vendor_id)""",
    "alias": """select 'mideast' as alias, 'Middle East' as target union all select 'twins', 'nation_1' union all select 'twins', 'NATION_2' union all select 'twins', 'nowhere' union all select 'gone', 'nothing'
        union all select 'guide', 'platform guide' union all select 'asian', 'asia'""",
    "answer": """select cast(p_partkey as bigint) as answer_id, p_size as size, 'The first claim [' || (p_size % 7) || ']. A second one [' || (p_size % 5) || ', ' || (p_size % 11) || '] holds. [' || (p_partkey % 4) || '] Third'
        || case when p_partkey % 3 = 0 then ' has many [1] [2] [3] [4] [5] [6] [7] [8] [9]!' when p_partkey % 3 = 1 then ' has none.' else '? [2]' end as text from {part} where p_partkey % 10 <> 9
        union all select cast(p_partkey as bigint), p_size, 'Nothing is cited. At all.' from {part} where p_partkey % 10 = 9""",
    # Facts as search finds them: texts with a subject, a relation, times and a source.
    "claim": """select doc_id as claim_id, text, lang, cast(doc_id % 100 + 1 as bigint) as source_id, doc_id % 40 as subject, doc_id % 7 as relation, doc_id % 900 as valid_day,
        case when doc_id % 5 = 0 then 500 when doc_id % 7 = 0 then 1200 end as invalid_day, doc_id % 11 = 0 as swept from {documents}""",
    "claim_scope": "select claim_id, vendor, product, source from {claim} join {source} using (source_id) join {product} using (product_id) join {vendor} using (vendor_id)",
    # Replies of models, as JSON texts; some can't be used.
    "label_reply": """select event_id, user_id, cast(1 + event_id % 3 as int) as n, case event_id % 7 when 0 then '{{"labels":[{{"n":1,"verdict":"stated"}},{{"n":2,"verdict":"unsupported"}}]}}' when 1 then '{{"labels":[{{"n":1,"verdict":"unsupported"}}]}}'
        when 2 then '{{"labels":[{{"n":2,"verdict":"stated"}},{{"n":1,"verdict":"unsupported"}},{{"n":3,"verdict":"stated"}}]}}' when 3 then '{{"labels":[{{"n":1,"verdict":"stated"}},{{"n":1,"verdict":"stated"}}]}}'
        when 4 then '{{"labels":[{{"n":1,"verdict":"maybe"}}]}}' when 5 then 'not json' else '{{"labels":[{{"n":3,"verdict":"unsupported"}},{{"n":1,"verdict":"unsupported"}},{{"n":2,"verdict":"stated"}}]}}' end as reply from {events}""",
    "judgement": """select event_id, cast(1 + event_id % 2 as int) as n_gold, '{{"gold":' || case event_id % 5 when 0 then '[true]' when 1 then '[true,false]' when 2 then '[]' when 3 then '[true,false]' else '[false]' end
        || ',"citations_ok":' || case when event_id % 11 = 0 then 'null' else 'true' end || ',"abstained":' || case when event_id % 4 = 0 then 'true' else 'false' end || '}}' as record from {events}""",
    # Edges that are proposed beside those of a reply (a call): both ends by name, with a quote.
    "proposed_edge": """select l_orderkey as call_id, l_linenumber as pos, l_partkey % 30 as src, case when l_linenumber = 5 then l_partkey % 30 else l_suppkey % 30 end as dst, l_quantity > 10 as quoted, l_returnflag as relation from {lineitem}""",
    "call_edge": "select o_orderkey as call_id, o_custkey % 30 as src, (o_custkey + 7) % 30 as dst from {orders}",
}
