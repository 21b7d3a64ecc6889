"""The catalogue's queries in DuckDB SQL, by query name."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    # S1.1
    "idx_scalar_1d": 'SELECT event_id, value FROM events WHERE event_id = 42',
    # S1.1
    "idx_negative_wrap_1d": 'SELECT event_id, value FROM events WHERE event_id = (SELECT count(*) FROM events) - 3',
    # S1.2
    "idx_slice_1d": 'SELECT event_id - 200 AS o0, value FROM events WHERE event_id >= 200 AND event_id < 400',
    # S1.2
    "idx_slice_strided_1d": 'SELECT (event_id - 200) // 7 AS o0, value FROM events WHERE event_id >= 200 AND event_id < 900 AND (event_id - 200) % 7 = 0',
    # S1.1,S1.2
    "idx_basic_2d_drop_axis": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT d1 - 8 AS o0, v FROM m WHERE d0 = 7 AND d1 >= 8 AND d1 < 40',
    # S1.3
    "idx_ellipsis_3d": 'WITH t AS (SELECT o_orderkey//500 AS d0,(o_orderkey//25)%20 AS d1,o_orderkey%25 AS d2,o_totalprice AS v FROM orders) SELECT d0 AS o0, d1 AS o1, v FROM t WHERE d2 = 24',
    # S1.4
    "idx_oindex_int_2d": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings), r(o0,d0) AS (VALUES (0,90),(1,3),(2,3)), c(o1,d1) AS (VALUES (0,60),(1,0)) SELECT CAST(o0 AS BIGINT) AS o0, CAST(o1 AS BIGINT) AS o1, v FROM m JOIN r USING (d0) JOIN c USING (d1)',
    # S1.5
    "idx_oindex_bool_1d": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS o0, value FROM events WHERE event_type = 'error'",
    # S1.6
    "idx_vindex_2d": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings), s(o0,d0,d1) AS (VALUES (0,5,0),(1,499,63),(2,5,0)) SELECT CAST(o0 AS BIGINT) AS o0, v FROM s JOIN m USING (d0,d1)',
    # S1.7
    "idx_mask_2d": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT row_number() OVER (ORDER BY d0,d1) - 1 AS o0, v FROM m WHERE v > 0.3',
    # S1.8
    "idx_block_1d": 'SELECT event_id - 1400 AS o0, value FROM events WHERE event_id // 700 = 2 AND event_id >= 1400',
    # S1.8
    "idx_block_2d": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT d0-100 AS o0, d1-16 AS o1, v FROM m WHERE d0//100 BETWEEN 1 AND 2 AND d1//16 = 1',
    # S1.9
    "idx_fields": 'SELECT o_orderkey AS d0, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey < 100',
    # S2.1
    "plan_accessed_chunks": 'SELECT DISTINCT event_id//50 AS c0 FROM events WHERE event_id >= 200 AND event_id < 400 AND (event_id-200)%100=0',
    # S2.1,S2.2
    "plan_projection_coverage": 'SELECT event_id//700 AS c0, min(event_id%700) AS sel_start, max(event_id%700)+1 AS sel_stop, min(event_id)-500 AS out_start, (count(*) = least(700,(SELECT count(*) FROM events)-700*(event_id//700))) AS is_complete FROM events WHERE event_id>=500 AND event_id<3000 GROUP BY event_id//700',
    # S2.4
    "plan_coordinate_groups": 'WITH s AS (SELECT l_orderkey AS d0 FROM lineitem) SELECT d0//700 AS c0, count(*) AS nitems, CAST(sum(count(*)) OVER (ORDER BY d0//700) AS BIGINT) AS cumsum FROM s GROUP BY d0//700',
    # S3.1
    "grid_regular_chunks": 'WITH g AS (SELECT unnest(range(0,CAST(ceil((SELECT count(*) FROM events)/700.0) AS BIGINT))) AS c0) SELECT c0, c0*700 AS chunk_offset, 700 AS chunk_size, least(700,(SELECT count(*) FROM events)-c0*700) AS data_size FROM g',
    # S3.2
    "grid_rectilinear_locate": 'SELECT CAST(CASE WHEN event_id<100 THEN 0 WHEN event_id<300 THEN 1 ELSE 2 END AS BIGINT) AS c0, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1',
    # S3.8
    "grid_chunk_keys": "WITH m AS (SELECT DISTINCT vec_id//100 AS c0, (generate_subscripts(embedding,1)-1)//16 AS c1 FROM embeddings) SELECT c0, c1, 'c/'||c0||'/'||c1 AS key_default, c0||'.'||c1 AS key_v2 FROM m",
    # S3.6
    "grid_morton_order": 'WITH g AS (SELECT DISTINCT s_suppkey%4 AS x, CAST(s_nationkey%4 AS BIGINT) AS y FROM supplier) SELECT x,y,((x&1) | ((y&1)<<1) | ((x&2)<<1) | ((y&2)<<2)) AS z FROM g',
    # S4.1
    "arr_fill_missing": "SELECT o.o_orderkey AS d0, coalesce(e.value,0.0) AS v FROM orders o LEFT JOIN (SELECT * FROM events WHERE event_type='error') e ON e.event_id=o.o_orderkey",
    # S4.14
    "arr_chunks_initialized": "SELECT count(DISTINCT event_id//50) AS n FROM events WHERE event_type='error' AND value<>0",
    # S4.4
    "arr_empty_chunk_elision": "SELECT c0 FROM (SELECT event_id//10 AS c0, bool_and(event_type<>'error') AS is_empty FROM events GROUP BY 1) WHERE NOT is_empty",
    # S4.2
    "arr_setitem_slice": 'SELECT event_id AS d0, CASE WHEN event_id>=100 AND event_id<200 THEN -1.0 ELSE value END AS v FROM events',
    # S4.2
    "arr_setitem_mask": 'SELECT event_id AS d0, CASE WHEN value>400 THEN 0.0 ELSE value END AS v FROM events',
    # S4.3
    "arr_setitem_coords_last_wins": 'WITH s(ord,d0,nv) AS (VALUES (0,5,1.5),(1,9,2.5),(2,5,3.5)), l AS (SELECT CAST(d0 AS BIGINT) AS d0, arg_max(CAST(nv AS DOUBLE),ord) AS nv FROM s GROUP BY d0) SELECT event_id AS d0, coalesce(l.nv,value) AS v FROM events LEFT JOIN l ON l.d0=event_id',
    # S4.7
    "arr_resize_shrink": 'SELECT event_id AS d0, value AS v FROM events WHERE event_id<777',
    # S4.7
    "arr_resize_grow": 'WITH r AS (SELECT unnest(range(0,(SELECT count(*) FROM events)+100)) AS d0) SELECT d0, coalesce(value,0.0) AS v FROM r LEFT JOIN events ON event_id=d0',
    # S4.8
    "arr_append_axis0": 'SELECT event_id AS d0, value AS v FROM events UNION ALL SELECT o_orderkey+(SELECT count(*) FROM events), o_totalprice FROM orders',
    # S4.11
    "arr_rechunk": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1 FROM embeddings) SELECT d0//50 AS c0, d1//32 AS c1, count(*) AS n FROM m GROUP BY 1,2',
    # S5.5
    "codec_transpose": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT d1 AS d0, d0 AS d1, v FROM m',
    # S5.7
    "codec_scale_offset": 'SELECT o_orderkey AS d0, (o_orderkey-10)*3 AS enc, ((o_orderkey-10)*3)//3+10 AS dec FROM orders',
    # S5.6
    "codec_cast_clamp": 'SELECT event_id AS d0, CAST(greatest(0,least(255,round_even(value,0))) AS SMALLINT) AS v FROM events',
    # S5.6
    "codec_cast_wrap": 'SELECT o_orderkey AS d0, CAST(((o_orderkey%256)+256)%256 AS SMALLINT) AS v FROM orders',
    # S5.16
    "codec_delta": 'SELECT o_orderkey AS d0, o_custkey - coalesce(lag(o_custkey) OVER (ORDER BY o_orderkey),0) AS delta FROM orders',
    # S5.18
    "codec_fixedscaleoffset": 'SELECT event_id AS d0, CAST(round_even((value-10)*100,0) AS BIGINT) AS enc FROM events',
    # S7.5
    "hier_implicit_groups": "WITH n AS (SELECT r_name||'/'||n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey) SELECT path,'array' AS kind FROM n UNION ALL SELECT DISTINCT split_part(path,'/',1),'group' FROM n UNION ALL SELECT '','group'",
    # S7.2
    "hier_nmembers": 'SELECT r_name AS path, count(*) AS nmembers FROM region JOIN nation ON n_regionkey=r_regionkey GROUP BY r_name',
    # S6.1
    "store_list_prefix": "SELECT url AS key FROM pages WHERE starts_with(url,'http://t')",
    # S6.1
    "store_getsize_prefix": 'SELECT source AS prefix, CAST(sum(octet_length(encode(text))) AS BIGINT) AS nbytes FROM documents GROUP BY source',
    # S6.2
    "store_byte_range": 'SELECT page_id, substr(url,3,5) AS rng, substr(url,9) AS off, right(url,4) AS suf FROM pages',
    # S6.3
    "store_coalesce_gap": 'WITH r AS (SELECT l_orderkey AS s, l_orderkey+3 AS e FROM lineitem GROUP BY l_orderkey), f AS (SELECT s,e,CASE WHEN s-max(e) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)<=2 THEN 0 ELSE 1 END AS nw FROM r), g AS (SELECT s,e,sum(nw) OVER (ORDER BY s) AS gid FROM f) SELECT min(s) AS start_, max(e) AS end_, count(*) AS n FROM g GROUP BY gid',
    # S8.3
    "lazy_compose": 'SELECT (event_id-10)//2 - 3 AS o0, value FROM events WHERE event_id>=10 AND event_id<50 AND (event_id-10)%2=0 AND (event_id-10)//2>=3 AND (event_id-10)//2<12',
    # S8.1
    "lazy_reverse": 'SELECT (SELECT count(*) FROM events)-1-event_id AS o0, value FROM events',
    # S8.1
    "lazy_literal_strided": 'SELECT event_id//2 AS coord, value FROM events WHERE event_id>=5 AND event_id<11 AND (event_id-5)%2=0',
    # S8.6
    "lazy_bounding_box": 'SELECT CAST(min(l_partkey) AS BIGINT) AS lo, CAST(max(l_partkey)+1 AS BIGINT) AS hi FROM lineitem',
    # S3.4
    "util_rle": 'WITH x AS (SELECT c_custkey AS i, c_nationkey AS v FROM customer), f AS (SELECT i,v,CASE WHEN v=lag(v) OVER (ORDER BY i) THEN 0 ELSE 1 END AS nw FROM x), g AS (SELECT i,v,sum(nw) OVER (ORDER BY i) AS gid FROM f) SELECT min(i) AS first_i, min(v) AS size, count(*) AS cnt FROM g GROUP BY gid',
    # S2.6
    "grid_iterate_2d": 'WITH n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT a.c0, b.c1 FROM n, LATERAL (SELECT unnest(range(0,(n.n+99)//100)) AS c0) a, (SELECT unnest(range(0,4)) AS c1) b) SELECT c0, c1, c0*100 AS offset0, c1*16 AS offset1, least(100,(SELECT n FROM n)-c0*100) AS data0, CAST(16 AS BIGINT) AS data1 FROM g',
    # S2.7
    "grid_rectilinear_regions": 'WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT 0 AS c0, 0 AS start, 100 AS stop UNION ALL SELECT 1,100,300 UNION ALL SELECT 2,300,n FROM n) SELECT CAST(c0 AS BIGINT) AS c0, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e',
    # S2.8,S3.7
    "grid_shard_keys": "WITH n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT a.c0, b.c1 FROM n, LATERAL (SELECT unnest(range(0,(n.n+99)//100)) AS c0) a, (SELECT unnest(range(0,4)) AS c1) b) SELECT c0, c1, 'c/'||c0||'/'||c1 AS key FROM g",
    # S2.3
    "plan_projection_2d": 'WITH n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT a.c0, b.c1 FROM n, LATERAL (SELECT unnest(range(0,(n.n+99)//100)) AS c0) a, (SELECT unnest(range(0,4)) AS c1) b) SELECT c0, c1, (c0*100>=50 AND least((c0+1)*100,(SELECT n FROM n))<=150 AND c1*16>=8 AND (c1+1)*16<=40) AS is_complete FROM g WHERE c0<2 AND c1<3',
    # S1.5
    "idx_oindex_bool_axis_2d": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT d0 AS o0, CAST(d1//3 AS BIGINT) AS o1, v FROM m WHERE d0<20 AND d1%3=0',
    # S1.12
    "idx_vindex_frame": 'SELECT CAST(l_linenumber AS BIGINT) AS o, o_totalprice AS v FROM lineitem JOIN orders ON o_orderkey=l_orderkey',
    # S1.10
    "idx_zero_axes": 'SELECT max(value) AS v FROM events',
    # S4.2
    "arr_setitem_list": 'SELECT event_id AS d0, CASE WHEN event_id IN (3,99,7) THEN -5.0 ELSE value END AS v FROM events',
    # S4.2
    "arr_setitem_orthogonal_array": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT m.d0, CAST(m.d1 AS BIGINT) AS d1, coalesce(p.v,m.v) AS v FROM m LEFT JOIN m p ON m.d0 IN (1,2) AND m.d1 BETWEEN 10 AND 13 AND p.d0=10-m.d0 AND p.d1=m.d1-10',
    # S4.2,S1.8
    "arr_setitem_block": 'SELECT event_id AS d0, CASE WHEN event_id<700 THEN 0.5 ELSE value END AS v FROM events',
    # S4.16
    "arr_describe": 'SELECT count(*) AS size, 8*count(*) AS nbytes, (count(*)+699)//700 AS nchunks FROM events',
    # S9.1
    "arr_metadata_round_trip": 'WITH n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT a.c0, b.c1 FROM n, LATERAL (SELECT unnest(range(0,(n.n+99)//100)) AS c0) a, (SELECT unnest(range(0,4)) AS c1) b) SELECT c0, c1, CAST(100 AS BIGINT) AS rows, CAST(16 AS BIGINT) AS columns FROM g',
    # S4.5,S4.10,S5.4,S5.11,S5.13
    "store_files_gzip": 'SELECT event_id AS d0, value AS v FROM events',
    # S5.8,S5.12
    "store_files_shards": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT d0-30 AS o0, CAST(d1-5 AS BIGINT) AS o1, v FROM m WHERE d0>=30 AND d0<60 AND d1>=5 AND d1<20',
    # S5.1,S5.3,S5.22
    "store_files_filters": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) SELECT d0, CAST(d1 AS BIGINT) AS d1, d0*64+d1 AS v FROM m',
    # S5.17
    "codec_quantize": 'SELECT event_id AS d0, round_even(value*128,0)/128 AS v FROM events',
    # S5.20
    "codec_packbits": "SELECT event_id//8 AS byte, CAST(sum(CASE WHEN event_type='error' THEN 1<<(7-CAST(event_id%8 AS INTEGER)) ELSE 0 END) AS SMALLINT) AS bits FROM events GROUP BY 1",
    # S5.16
    "codec_delta_sparse": 'SELECT o_orderkey AS d0, o_custkey - coalesce(lag(o_custkey) OVER (ORDER BY o_orderkey),0) AS delta FROM orders WHERE o_orderkey%97=0',
    # S5.18
    "codec_fixedscaleoffset_decode": 'SELECT o_orderkey AS d0, o_orderkey/4.0+10.0 AS v FROM orders',
    # S7.2
    "hier_children": "WITH n AS (SELECT r_name, r_name||'/'||n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey) SELECT path, 'ASIA' AS parent, CAST(2 AS BIGINT) AS depth FROM n WHERE r_name='ASIA'",
    # S7.1,S7.3
    "hier_groups": "WITH n AS (SELECT r_name, r_name||'/'||n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey) SELECT DISTINCT r_name AS path FROM n",
    # S7.4
    "hier_deleted": "WITH n AS (SELECT r_name, r_name||'/'||n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey) SELECT path FROM n WHERE r_name<>'ASIA'",
    # S7.5,S7.6
    "hier_overwritten": "WITH n AS (SELECT r_name, r_name||'/'||n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey) SELECT path,'array' AS kind FROM n WHERE r_name<>'ASIA' UNION ALL SELECT DISTINCT r_name,'group' FROM n WHERE r_name<>'ASIA' UNION ALL SELECT 'ASIA','array' UNION ALL SELECT '','group'",
    # S7.8
    "hier_consolidated": "WITH n AS (SELECT r_name, r_name||'/'||n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey) SELECT path, '{}' AS meta FROM n WHERE r_name='EUROPE'",
    # S11.1
    "hier_migrated": "SELECT n_name AS path, CAST(n_nationkey+1 AS BIGINT) AS extent, CAST(n_regionkey+1 AS BIGINT) AS chunk, 'numcodecs.delta,bytes,numcodecs.zlib' AS codecs FROM nation",
    # S6.2
    "store_get_many": 'SELECT CAST(doc_id AS VARCHAR) AS key, left(substr(hex(encode(text)),5),14) AS bytes FROM documents WHERE text IS NOT NULL',
    # S6.1
    "store_list_dir": 'SELECT DISTINCT source AS name FROM documents',
    # S8.2,S8.4
    "lazy_oindex": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) , r(o0,d0) AS (VALUES (0,14),(1,10),(2,14)) SELECT CAST(o0 AS BIGINT) AS o0, CAST(d1//16 AS BIGINT) AS o1, v FROM m JOIN r USING (d0) WHERE d1%16=0',
    # S8.4
    "lazy_vindex": 'WITH m AS (SELECT vec_id AS d0, generate_subscripts(embedding,1)-1 AS d1, unnest(embedding) AS v FROM embeddings) , s(o0,d0,d1) AS (VALUES (0,5,0),(1,99,63),(2,5,0)) SELECT CAST(o0 AS BIGINT) AS o0, v FROM s JOIN m USING (d0,d1)',
    # S2.5
    "plan_order": 'WITH o AS (SELECT o_totalprice AS v, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS w FROM orders) SELECT \'increasing\' AS direction, \'d0\' AS "of" UNION ALL SELECT \'decreasing\',\'back\' UNION ALL SELECT CASE WHEN bool_and(v>=w) THEN \'increasing\' WHEN bool_and(v<=w) THEN \'decreasing\' ELSE \'unordered\' END, \'price\' FROM o WHERE w IS NOT NULL',
    # S10.3
    "store_valid_keys": "SELECT vec_id, (CASE WHEN vec_id%7=0 THEN 'c/0' ELSE 'c/' END)||(vec_id//10)||'/'||(vec_id%6) AS key, (vec_id%7<>0 AND vec_id//10 < ((SELECT count(*) FROM embeddings)+99)//100 AND vec_id%6 < 4) AS valid FROM embeddings",
    # S10.2
    "http_range": 'WITH t AS (SELECT o_orderkey AS k, o_custkey%200 AS n, o_orderkey%6 AS f, o_orderkey%50 AS a, o_orderkey%70 AS b, o_orderkey%300 AS c, o_orderkey%5 AS s FROM orders), u AS (SELECT *, CASE WHEN f>=3 THEN 200 WHEN f=0 THEN CASE WHEN a<=b AND a<n THEN 206 ELSE 416 END WHEN f=1 THEN CASE WHEN c<n THEN 206 ELSE 416 END ELSE CASE WHEN s>0 AND n>0 THEN 206 ELSE 416 END END AS status FROM t) SELECT k AS d0, CAST(status AS BIGINT) AS status, CAST(CASE WHEN status=416 THEN NULL WHEN f>=3 THEN 0 WHEN f=0 THEN a WHEN f=1 THEN c ELSE greatest(0,n-s) END AS BIGINT) AS start, CAST(CASE WHEN status=416 THEN NULL WHEN f=0 THEN least(n,b+1) ELSE n END AS BIGINT) AS stop FROM u',
    # S8.5
    "lazy_chunks": 'WITH r(d0) AS (VALUES (5),(0),(99),(5)), c AS (SELECT unnest(range(0,16))*2 AS d1) SELECT CAST(d0//100 AS BIGINT) AS c0, CAST(d1//16 AS BIGINT) AS c1, count(*) AS n, false AS whole FROM r, c GROUP BY 1,2',
    # S8.10
    "lazy_within": 'SELECT -event_id AS o0, value FROM events WHERE event_id>=100 AND event_id<900',
}
