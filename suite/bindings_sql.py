"""The corpus bindings once more as SQL, for the oracle. Name -> (columns, body)."""

from __future__ import annotations

from memstrata.functions.scalars import diacritic_map

ACCENTED, BASE = diacritic_map()


def sql_tokens(expr: str) -> str:
    folded = rf"regexp_replace(translate(lower({expr}), '{ACCENTED}', '{BASE}'), '[\x{{300}}-\x{{36f}}]', '', 'g')"
    return rf"regexp_extract_all({folded}, '[\p{{L}}\p{{N}}]+')"


T0 = "TIMESTAMP '2024-01-01'"


def after(days: str = "0", minutes: str = "0") -> str:
    return f"({T0} + to_days(cast({days} as integer)) + to_minutes(cast({minutes} as bigint)))"


OP_KIND = ("case event_type when 'signup' then 'remember' when 'view' then 'recall' when 'purchase' then 'consolidation' "
           "when 'error' then 'assimilation' else 'extraction' end")
CALL_KIND = ("case event_type when 'view' then 'recall' when 'click' then 'embedding' when 'purchase' then 'consolidation' "
             "when 'signup' then 'remember' else 'assimilation' end")

CTES: dict[str, tuple[str, str]] = {
    "c_calls": ("", f"select doc_id call_id, text raw, sha256(text) h, {after('doc_id % 30', 'doc_id % 1440')} \"at\" from documents"),
    "c_reg": ("", """select 'src_' || h id, h content_hash,
        'sources/' || strftime("at", '%Y/%m/%d') || '/src_' || h || '.md' relative_path, "at" created_at,
        case when call_id % 50 = 0 then 'failed' when call_id % 50 = 1 then 'pending' else 'complete' end status,
        call_id first_call_id, raw
        from (select *, row_number() over (partition by h order by "at", call_id) rn from c_calls) where rn = 1"""),
    "c_obs": ("", """select row_number() over (order by created_at, content_hash, idx) seq, * from (
        select 'mem_' || substr(content_hash, 1, 24) || '_' || i id, ls[i + 1] content, id source_ref,
               created_at + to_minutes(i) created_at, content_hash, i idx, ls[i + 1] line, 'source:' || id || ':' || i origin_key
        from (select *, unnest(range(len(ls))) i from (
            select *, flatten(list_transform(list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> ''),
                lambda x: list_transform(range(0, length(x), 4000), lambda k: substr(x, k + 1, 4000)))) ls
            from c_reg where status = 'complete')))"""),
    "c_n": ("", "select n0, n0 // 5 k1, (n0 // 5) // 4 k2, n0 + n0 // 5 + (n0 // 5) // 4 total from (select count(*) n0 from c_obs)"),
    "c_one": ("", f"""select n0 + 1 + seq % k1 seq, 'mem_d1_' || (seq % k1) id, 1::bigint depth, 'Pattern ' || (seq % k1) || ' ' || content as content,
        null::varchar source_ref, {after('31 + (seq % k1) % 14')} created_at, 1 + (seq % k1) % 30 dream_revision, 'fixture-dream' created_by_model,
        'run:' || (1 + (seq % k1) % 30) || ':abstract:' || id || ':0' origin_key, seq % k1 g
        from c_obs, c_n where seq <= k1"""),
    "c_base": ("", f"""select seq, id, 0::bigint depth, content, source_ref, created_at, 0::bigint dream_revision, 'fixture-extract' created_by_model, origin_key from c_obs
        union all select seq, id, depth, content, source_ref, created_at, dream_revision, created_by_model, origin_key from c_one
        union all select n0 + k1 + 1 + g, 'mem_d2_' || g, 2, 'Theme ' || g || ' ' || content, null, {after('46 + g % 7')}, 61 + g % 4, 'fixture-meditation',
            'run:' || (61 + g % 4) || ':abstract:' || id || ':0' from c_one, c_n where g < k2"""),
    "c_recalls": ("", """select event_id + 1 seq, b.id memory_id, ts recalled_at from events, c_n, c_base b
        where event_type = 'view' and b.seq = 1 + (event_id * 31) % total"""),
    "c_mem": ("", """select b.*, true sealed, l.last_recalled_at from c_base b
        left join (select memory_id, max(recalled_at) last_recalled_at from c_recalls group by 1) l on l.memory_id = b.id"""),
    "c_df": ("", """select 'mem_d1_' || (seq % k1) child_id, id parent_id from c_obs, c_n
        union all select 'mem_d2_' || (g % k2), id from c_one, c_n"""),
    "c_anc": ("(start, memory_id)", """select id, id from c_mem
        union select a.start, d.parent_id from c_anc a join c_df d on d.child_id = a.memory_id"""),
    "c_roots": ("", "select distinct a.start memory_id, m.source_ref source_id from c_anc a join c_mem m on m.id = a.memory_id where m.source_ref is not null"),
    "c_rel": ("", f"""select (owner_seq - n0 - 1) * 3 + j + 1 seq, memory_id, o.id related_memory_id, kind,
            {after('31 + (owner_seq + j) % 21')} related_at, 32 + (owner_seq + j) % 21 run_id
        from (select memory_id, owner_seq, target_seq, kind, min(j) j from (
            select id memory_id, seq owner_seq, j, 1 + (seq * 7919 + j * 104729) % n0 target_seq,
                   case when (seq + j) % 5 = 0 then 'negative' else 'positive' end kind
            from c_base, c_n, (select unnest([0, 1, 2])::bigint j) where depth >= 1) group by 1, 2, 3, 4) e, c_n, c_obs o
        where o.seq = e.target_seq"""),
    "c_edges": ("", """select r.*, o.depth owner_depth, t.depth target_depth from c_rel r
        join c_mem o on o.id = r.memory_id join c_mem t on t.id = r.related_memory_id"""),
    "c_runs": ("", f"""select p.*, coalesce((select max(seq) from c_base where created_at < period_end), 0) memory_high_water,
            coalesce((select max(seq) from c_rel where related_at < period_end), 0) relation_high_water,
            coalesce((select max(seq) from c_recalls where recalled_at < period_end), 0) recall_high_water,
            period_end + to_hours(1) started_at,
            case when id = 65 then 'budget_exhausted' else 'complete' end status,
            case when kind = 'meditation' then 1.00::decimal(38, 12) end budget_usd
        from (select i id, case when i <= 60 then 'dream' else 'meditation' end kind,
                {after('case when i <= 60 then i - 1 else (i - 61) * 7 end')} period_start,
                {after('case when i <= 60 then i else (i - 60) * 7 end')} period_end
              from (select unnest(range(1, 69)) i)) p"""),
    "c_seeds": ("", """select r.id run_id, m.id memory_id, m.created_at from c_runs r, c_mem m
            where r.kind = 'dream' and m.depth = 0 and m.created_at >= r.period_start and m.created_at < r.period_end and m.seq <= r.memory_high_water
        union select r.id, m.id, m.created_at from c_runs r, c_recalls e, c_mem m
            where r.kind = 'dream' and e.recalled_at >= r.period_start and e.recalled_at < r.period_end and e.seq <= r.recall_high_water
              and m.id = e.memory_id and m.seq <= r.memory_high_water"""),
    "c_dream": ("", """select run_id, work_key, phase, memory_id, row_number() over (partition by run_id order by p, created_at, memory_id) - 1 ordinal from (
            select r.id run_id, 'assimilate:' || m.id work_key, 'assimilation' phase, m.id memory_id, m.created_at, 0 p from c_runs r, c_mem m
            where r.kind = 'dream' and m.depth = 0 and m.created_at >= r.period_start and m.created_at < r.period_end and m.seq <= r.memory_high_water
            union all select run_id, 'abstract:' || memory_id, 'consolidation', memory_id, created_at, 1 from c_seeds)"""),
    "c_changed": ("", """select r.id run_id, m.id memory_id from c_runs r, c_mem m where m.depth >= 1 and m.created_at >= r.period_start
              and m.created_at < r.period_end and m.seq <= r.memory_high_water
        union select r.id, e.memory_id from c_runs r, c_rel e, c_mem m, c_mem t where e.related_at >= r.period_start and e.related_at < r.period_end
              and e.seq <= r.relation_high_water and m.id = e.memory_id and m.seq <= r.memory_high_water and m.depth >= 1
              and t.id = e.related_memory_id and t.seq <= r.memory_high_water"""),
    "c_weekly": ("", """select run_id, 'abstract:' || memory_id work_key, 'consolidation' phase, memory_id from c_changed
        where run_id in (select id from c_runs where kind = 'meditation')"""),
    "c_work": ("", """select *, case when run_id = 65 and ordinal % 2 = 1 then 'pending' else 'complete' end status,
            case when run_id = 65 and ordinal % 2 = 1 then null when phase = 'assimilation' then 'fixture-relate'
                 when ordinal % 3 = 0 then 'consolidation-ineligible' when ordinal % 3 = 1 then 'dream-neighborhood-deduplicated'
                 else 'fixture-abstract' end model,
            case when run_id = 65 and ordinal % 2 = 1 then null when phase = 'consolidation' and ordinal % 6 = 2 then 1 else 0 end n_abstractions
        from (select run_id, work_key, phase, memory_id, ordinal from c_dream
              union all select run_id, work_key, phase, memory_id, row_number() over (partition by run_id order by work_key) - 1 from c_weekly)"""),
    "c_api": ("", f"""select 'call_' || event_id id, event_id ordinal, case when event_type <> 'signup' then 1 + user_id % 30 end run_id,
            case when user_id % 2 = 0 then 'model-a' else 'model-b' end model,
            case when event_id % 3 = 0 then 'scope-' || (user_id % 5) || '/' else '' end || {CALL_KIND} operation, {CALL_KIND} plain_operation,
            reserved_usd, case when event_id % 10 <> 0 then (reserved_usd * 0.8::decimal(2, 1))::decimal(30, 12) end actual_usd,
            ts created_at, case when event_id % 10 <> 0 then ts + to_seconds(event_id % 3600) end completed_at,
            case when event_id % 10 <> 0 then 1000 + 10 * k end input_tokens, case when event_id % 10 <> 0 then k end cached_tokens,
            case when event_id % 10 <> 0 then 5 * k end output_tokens, case when event_id % 10 <> 0 then 0 end write_tokens
        from (select *, (round(value * 100)::decimal(18, 0) * 0.00001::decimal(6, 5))::decimal(30, 12) reserved_usd,
                     json_extract(props, '$.k')::bigint k from events)"""),
    "c_ops0": ("", f"""select event_id, ts, user_id, {OP_KIND} kind, json_extract(props, '$.k')::bigint k from events"""),
    "c_refs": ("", """select o.event_id, o.role, o.pos, b.id, b.source_ref from (
            select event_id, 'created' as role, i pos, 1 + (event_id * 31 + i * 7) % n0 seq from c_ops0, c_n, (select unnest(range(5)) i) where kind = 'extraction' and i < event_id % 3
            union all select event_id, 'returned', i, 1 + (event_id * 37 + i * 101) % total from c_ops0, c_n, (select unnest(range(5)) i) where kind = 'recall' and event_id % 11 <> 0 and i < event_id % 4
            union all select event_id, 'candidate', i, 1 + (event_id * 37 + i * 101) % total from c_ops0, c_n, (select unnest(range(5)) i) where kind = 'recall' and event_id % 11 <> 0 and i < event_id % 4 + 1
            union all select event_id, 'seed', 0, 1 + (event_id * 17) % n0 from c_ops0, c_n where kind in ('assimilation', 'consolidation')
            union all select event_id, 'source', 0, 1 + (event_id * 13) % n0 from c_ops0, c_n where kind in ('remember', 'extraction')) o
        join c_base b on b.seq = o.seq"""),
    "c_reflist": ("", """select event_id, role, id from c_refs
        union all select event_id, r, 'mem_unknown' from c_ops0, (select unnest(['returned', 'candidate']) r) where kind = 'recall' and event_id % 41 = 0"""),
    "c_ops": ("", """select 'op_' || o.event_id id, o.event_id, kind, case when o.event_id % 7 = 0 then 'recovery' else 'agent' end origin,
            case when o.event_id % 4 = 1 then 'op_' || (o.event_id - 1) end parent_id, src.source_ref source_id,
            case when kind in ('assimilation', 'consolidation') then 1 + user_id % 30 end run_id,
            case kind when 'assimilation' then 'assimilate:' || seed.id when 'consolidation' then 'abstract:' || seed.id end work_key,
            ts started_at, ts + to_seconds(o.event_id % 120) completed_at,
            case when o.event_id % 17 = 0 then 'failed' else 'complete' end status, seed.id seed_id,
            case when kind = 'remember' then 100 + k end raw_characters, case when kind = 'remember' and o.event_id % 19 <> 0 then 100 + 2 * k end raw_bytes,
            case when kind = 'remember' then o.event_id % 3 <> 0 end new_source,
            case when kind in ('assimilation', 'consolidation') then o.event_id % 5 <> 0 end model_invoked,
            case when kind in ('assimilation', 'consolidation') then o.event_id % 6 = 0 end proposal_reused,
            case when kind = 'assimilation' then (o.event_id % 4)::bigint end n_relations,
            case when kind = 'extraction' then coalesce(n.created, 0) end n_created,
            case when kind = 'recall' then coalesce(n.returned, 0) end n_returned,
            case when kind = 'recall' then coalesce(n.candidates, 0) end n_candidates
        from c_ops0 o left join c_refs seed on seed.event_id = o.event_id and seed.role = 'seed'
        left join c_refs src on src.event_id = o.event_id and src.role = 'source'
        left join (select event_id, count(*) filter (role = 'created') created, count(*) filter (role = 'returned') returned,
                   count(*) filter (role = 'candidate') candidates from c_reflist group by 1) n on n.event_id = o.event_id"""),
    "c_links": ("", "select id api_call_id, 'op_' || ordinal activity_id from c_api where ordinal % 25 <> 0"),
    "c_results": ("", """select o.run_id, o.work_key, o.event_id % 3 proposal_index, o.id activity_id, o.completed_at "at",
            case o.event_id % 3 when 0 then 'appended' when 1 then 'already_exists' else 'rejected' end outcome, m.id memory_id, o.seed_id related_memory_id,
            case when o.event_id % 2 = 0 then 'positive' else 'negative' end kind, case when o.event_id % 3 = 2 then 'outside the run snapshot' end reason, o.event_id
        from c_ops o, c_n, c_base m where o.kind = 'assimilation' and m.seq = 1 + (o.event_id * 23) % total"""),
    "c_emb": ("", """select b.id memory_id, v.embedding vector, b.depth, b.seq, v.vec_id from c_base b, embeddings v, (select count(*) n from embeddings)
        where v.vec_id = b.seq % n"""),
    # the seeds of all daily and weekly runs, with what their run sees
    "c_hseed": ("", """select s.run_id, s.memory_id, r.kind, r.memory_high_water, r.relation_high_water
        from (select run_id, memory_id from c_seeds union select run_id, memory_id from c_weekly) s join c_runs r on r.id = s.run_id"""),
    # cosine of each two vectors; memories with one vector share it
    "c_vsim": ("", """select a.vec_id a, b.vec_id b, list_dot_product(a.v, b.v) / sqrt(a.sq * b.sq) score
        from (select vec_id, embedding::double[] v, list_dot_product(embedding::double[], embedding::double[]) sq from embeddings) a,
             (select vec_id, embedding::double[] v, list_dot_product(embedding::double[], embedding::double[]) sq from embeddings) b"""),
    # of each run, level and vector: the vectors, best first, until 21 memories in view stand before
    "c_vnear": ("", """select run_id, depth, a, b, score from (
            select *, min(upto) over (partition by run_id, depth, a, score) before from (
                select w.run_id, w.depth, w.a, s.b, s.score, sum(v.n) over (partition by w.run_id, w.depth, w.a order by s.score desc rows unbounded preceding) - v.n upto
                from (select distinct h.run_id, e.depth, e.vec_id a from c_hseed h join c_emb e using (memory_id)) w
                join c_vsim s on s.a = w.a
                join (select r.run_id, e.depth, e.vec_id b, count(*) n from (select distinct run_id, memory_high_water from c_hseed) r
                      join c_emb e on e.seq <= r.memory_high_water group by 1, 2, 3) v on v.run_id = w.run_id and v.depth = w.depth and v.b = s.b)) where before < 21"""),
    "c_fedge": ("", "select e.*, m.seq target_seq from c_edges e join c_mem m on m.id = e.related_memory_id"),
    # the daily runs' new memories, each a query of its own content in its run's view
    "c_aseed": ("", """select w.run_id, w.memory_id seed_id, r.memory_high_water, r.relation_high_water, m.content
        from c_work w join c_runs r on r.id = w.run_id join c_mem m on m.id = w.memory_id where w.phase = 'assimilation'"""),
    "c_aphr": ("", f"""select seed_id, term, count(*) weight from (
            select seed_id, {sql_tokens('t')}[1] term from (
                select seed_id, unnest(list_slice(u, 1, 64)) t from (
                    select seed_id, list_transform(list_sort(list_transform(list_distinct(ts), lambda x: {{'p': list_position(ts, x), 't': x}})), lambda s: s.t) u
                    from (select distinct seed_id, regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+') ts from c_aseed))))
        where term is not null group by 1, 2"""),
    "c_abm": (" MATERIALIZED", """select a.run_id, a.seed_id, l.memory_id, round(sum(p.weight * d.idf
                * (t.tf * 2.2) / (t.tf + 1.2 * (1 - 0.75 + 0.75 * l.doc_len / avg_len))), 9) score
            from c_aseed a join c_aphr p on p.seed_id = a.seed_id join c_post t on t.term = p.term
            join (select term, case when ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) <= 0 then 1e-6 else ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) end idf
                  from c_post, c_stats group by term, n_docs) d on d.term = p.term
            join c_len l on l.memory_id = t.memory_id and l.seq <= a.memory_high_water, c_stats group by 1, 2, 3"""),
    "c_alex": ("", """select b.run_id, b.seed_id, b.memory_id, row_number() over (partition by b.run_id, b.seed_id order by b.score desc, b.memory_id) rank
        from c_abm b join (select run_id, seed_id, list_min(max(score, 30)) least from c_abm group by 1, 2) k
        on k.run_id = b.run_id and k.seed_id = b.seed_id and b.score >= k.least qualify rank <= 30"""),
    "c_avnear": ("", """select run_id, a, b, score from (
            select *, min(upto) over (partition by run_id, a, score) before from (
                select w.run_id, w.a, s.b, s.score, sum(v.n) over (partition by w.run_id, w.a order by s.score desc rows unbounded preceding) - v.n upto
                from (select distinct h.run_id, e.vec_id a from c_aseed h join c_emb e on e.memory_id = h.seed_id) w
                join c_vsim s on s.a = w.a
                join (select r.run_id, e.vec_id b, count(*) n from (select distinct run_id, memory_high_water from c_aseed) r
                      join c_emb e on e.seq <= r.memory_high_water group by 1, 2) v on v.run_id = w.run_id and v.b = s.b)) where before < 30"""),
    "c_asem": ("", """select h.run_id, h.seed_id, e.memory_id, row_number() over (partition by h.run_id, h.seed_id order by n.score desc, e.memory_id) rank
        from c_aseed h join c_emb s on s.memory_id = h.seed_id join c_avnear n on n.run_id = h.run_id and n.a = s.vec_id
        join c_emb e on e.vec_id = n.b and e.seq <= h.memory_high_water qualify rank <= 30"""),
    "c_ahits": ("", """select *, row_number() over (partition by run_id, seed_id order by score desc, memory_id) rank from (
            select run_id, seed_id, memory_id, sum(1.0::double / (60 + rank)) score from (select * from c_alex union all select * from c_asem) group by 1, 2, 3)
        qualify row_number() over (partition by run_id, seed_id order by score desc, memory_id) <= 30"""),
    "c_q": ("", """select 'q' || item_id || case when item_id % 13 = 0 then '_abs' else '' end query_id, item_id,
        ['knowledge-update', 'multi-session', 'single-session-assistant', 'single-session-preference', 'single-session-user', 'temporal-reasoning'][item_id % 6 + 1] question_type,
        text from benchmark"""),
    "c_qvec": ("", "select q.query_id, v.embedding vector from c_q q join embeddings v on v.vec_id = q.item_id"),
    "c_gold": ("", "select q.query_id, s.id source_id from c_q q, c_reg s where contains(s.raw, q.text)"),
    # full-text index
    "c_tok": ("", f"select id memory_id, seq, depth, {sql_tokens('id')} a, {sql_tokens('content')} b from c_mem"),
    "c_len": ("", "select memory_id, seq, depth, len(a) + len(b) doc_len from c_tok"),
    "c_stats": ("", "select count(*) n_docs, avg(doc_len) avg_len from c_len"),
    "c_post": ("", """select term, memory_id, count(*) tf from (select memory_id, unnest(list_concat(a, b)) term from c_tok) group by 1, 2"""),
    "c_phr": ("", f"""select query_id, term, count(*) weight from (
            select query_id, {sql_tokens('t')}[1] term from (
                select query_id, unnest(list_slice(u, 1, 64)) t from (
                    select query_id, list_transform(list_sort(list_transform(list_distinct(ts), lambda x: {{'p': list_position(ts, x), 't': x}})), lambda s: s.t) u
                    from (select query_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') ts from c_q))))
        where term is not null group by 1, 2"""),
    "c_bm": ("", """select p.query_id, l.memory_id, l.seq, l.depth, round(sum(p.weight
            * case when ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_docs - df + 0.5) / (df + 0.5)) end
            * (t.tf * 2.2) / (t.tf + 1.2 * (1 - 0.75 + 0.75 * l.doc_len / avg_len))), 9) score
        from c_phr p join c_post t on t.term = p.term join (select term, count(*) df from c_post group by 1) d on d.term = p.term
        join c_len l on l.memory_id = t.memory_id, c_stats group by 1, 2, 3, 4"""),
    "c_lexa": ("", "select query_id, memory_id, row_number() over (partition by query_id order by score desc, memory_id) rank from c_bm where depth = 0 qualify rank <= 30"),
    "c_lexb": ("", "select query_id, memory_id, row_number() over (partition by query_id order by score desc, memory_id) rank from c_bm qualify rank <= 30"),
    "c_sim": ("", """select q.query_id, e.memory_id, e.depth, list_dot_product(q.vector::double[], e.vector::double[])
        / sqrt(list_dot_product(q.vector::double[], q.vector::double[]) * list_dot_product(e.vector::double[], e.vector::double[])) score from c_qvec q, c_emb e"""),
    "c_sema": ("", "select query_id, memory_id, row_number() over (partition by query_id order by score desc, memory_id) rank from c_sim where depth = 0 qualify rank <= 30"),
    "c_semb": ("", "select query_id, memory_id, row_number() over (partition by query_id order by score desc, memory_id) rank from c_sim qualify rank <= 30"),
    "c_fusea": ("", """select *, row_number() over (partition by query_id order by score desc, memory_id) rank from (
            select query_id, memory_id, sum(1.0::double / (60 + rank)) score from (select * from c_lexa union all select * from c_sema) group by 1, 2)
        qualify row_number() over (partition by query_id order by score desc, memory_id) <= 30"""),
    "c_fuseb": ("", """select *, row_number() over (partition by query_id order by score desc, memory_id) rank from (
            select query_id, memory_id, sum(1.0::double / (60 + rank)) score from (select * from c_lexb union all select * from c_semb) group by 1, 2)
        qualify row_number() over (partition by query_id order by score desc, memory_id) <= 30"""),
    "c_rank": ("", """select 'A' condition, query_id, 'lexical' list, rank, memory_id from c_lexa union all select 'B', query_id, 'lexical', rank, memory_id from c_lexb
        union all select 'A', query_id, 'semantic', rank, memory_id from c_sema union all select 'B', query_id, 'semantic', rank, memory_id from c_semb
        union all select 'A', query_id, 'fused', rank, memory_id from c_fusea union all select 'B', query_id, 'fused', rank, memory_id from c_fuseb"""),
    "c_cand": ("", "select condition, query_id, rank, memory_id from c_rank where list = 'fused'"),
    # sessions; a source is its own session in the evaluation
    "c_conv": ("", f"""select conv_id // 16 item_id, conv_id, 's' || conv_id session_id, conv_id % 16 ordinal, {after('conv_id % 30', 'conv_id % 1440')} ts,
        conv_id % 16 in (3, 7) is_gold, count(*) n_turns, sum(strlen(text))::bigint n_bytes from conversations group by conv_id"""),
    "c_pairs": ("", "select q.query_id, q.item_id, q.question_type, c.condition from c_q q, (select unnest(['A', 'B']) condition) c"),
    "c_hit": ("", """select distinct c.condition, c.query_id, c.rank from c_cand c join c_roots r on r.memory_id = c.memory_id
        join c_gold g on g.query_id = c.query_id and g.source_id = r.source_id"""),
    "c_flags": ("", """select p.*, hit and item_id % 3 <> 0 correct, hit, in_candidates, not hit and not in_candidates candidate_failure,
            not hit and in_candidates selection_failure, hit and not (hit and item_id % 3 <> 0) answer_failure from (
        select p.*, exists (select 1 from c_hit h where h.condition = p.condition and h.query_id = p.query_id and h.rank <= 5) hit,
               exists (select 1 from c_hit h where h.condition = p.condition and h.query_id = p.query_id) in_candidates from c_pairs p) p"""),
    "c_pair": ("", """select query_id, bool_or(hit) filter (condition = 'A') a, bool_or(hit) filter (condition = 'B') b from c_flags group by 1"""),
    # daily report, local dates of the default zone
    "c_attr": ("", """select a.*, l.activity_id, o.kind parent_kind, o.work_key parent_work_key, o.run_id parent_run_id,
            cast(timezone('Asia/Seoul', timezone('UTC', a.created_at)) as date) date
        from c_api a left join c_links l on l.api_call_id = a.id left join c_ops o on o.id = l.activity_id"""),
    "c_opsd": ("", "select *, cast(timezone('Asia/Seoul', timezone('UTC', started_at)) as date) date from c_ops"),
    "c_root": ("(id, root)", """select id, id from c_ops where parent_id is null
        union select o.id, r.root from c_ops o join c_root r on o.parent_id = r.id"""),
    "c_dayops": ("", """select distinct s.date, r.id from (select date, id from c_opsd union select date, activity_id from c_attr where activity_id is not null) s
        join c_root a on a.id = s.id join c_root r on r.root = a.root"""),
    "c_dayruns": ("", """select distinct date, run_id from (
        select d.date, o.run_id from c_dayops d join c_ops o on o.id = d.id union all select date, run_id from c_attr
        union all select cast(timezone('Asia/Seoul', timezone('UTC', started_at)) as date), id from c_runs) where run_id is not null"""),
    "c_srcd": ("", r"""select *, cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date) date,
        case when first_call_id % 9 <> 0 then length(raw) + len(regexp_extract_all(raw, '[\x{10000}-\x{10FFFF}]')) end raw_characters,
        case when first_call_id % 9 <> 0 then strlen(raw) end raw_bytes from c_reg"""),
}
