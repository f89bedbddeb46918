"""The first 32 bits of MD5 for every pairing of two lists of short texts, in numpy: a pair takes some tenth of a microsecond."""

from __future__ import annotations

import numpy as np

SINES = np.floor(np.abs(np.sin(np.arange(1.0, 65.0))) * 2.0**32).astype(np.uint64).astype(np.uint32)
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
PLACES = [*range(16), *((5 * t + 1) % 16 for t in range(16)), *((3 * t + 5) % 16 for t in range(16)), *(7 * t % 16 for t in range(16))]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def by_length(numbers: np.ndarray, before: str = "", after: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, bytes as a matrix) of the numbers' texts between ``before`` and ``after``, apart by length."""
    texts = np.array([f"{before}{n}{after}".encode() for n in numbers.tolist()], dtype=bytes)
    sizes = np.char.str_len(texts)
    return [(own, texts[own].astype(f"S{n}").view(np.uint8).reshape(len(own), n)) for n in np.unique(sizes) for own in [np.flatnonzero(sizes == n)]]


def first_words(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Of every head (n x p bytes) followed by every tail (m x q): the first four bytes of the MD5 as a number, n x m. p + q is at most 55."""
    (n, p), (m, q) = heads.shape, tails.shape
    left, right = np.zeros((n, 64), np.uint8), np.zeros((m, 64), np.uint8)
    left[:, :p], right[:, p : p + q], right[:, p + q] = heads, tails, 0x80
    left, right = left.view("<u4"), right.view("<u4")
    right[:, 14] = 8 * (p + q)
    message = []
    for w in range(16):
        row, column = left[:, w, None], right[None, :, w]
        message.append((row | column if row.any() else column) if column.any() else row if row.any() else None)
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in START)
    for t in range(61):  # what three more steps make is not in the first word
        if t < 16:
            mixed = d ^ (b & (c ^ d))
        elif t < 32:
            mixed = c ^ (d & (b ^ c))
        elif t < 48:
            mixed = b ^ c ^ d
        else:
            mixed = c ^ (b | ~d)
        word = message[PLACES[t]]
        mixed = mixed + (a + SINES[t] if word is None else a + (word + SINES[t]))
        turned = mixed << np.uint32(TURNS[t])
        mixed >>= np.uint32(32 - TURNS[t])
        turned |= mixed
        a, d, c, b = d, c, b, turned + b
    return (b + np.uint32(START[0])).byteswap()


MIXES = ["d[j] ^ (b[j] & (c[j] ^ d[j]))", "c[j] ^ (d[j] & (b[j] ^ c[j]))", "b[j] ^ c[j] ^ d[j]", "c[j] ^ (b[j] | ~d[j])"]
NEXT = ["c[j] ^ (y & (b[j] ^ c[j]))", "b[j] ^ (c[j] & (y ^ b[j]))", "y ^ b[j] ^ c[j]", "b[j] ^ (y | ~c[j])"]
HIT = "struct<u:bigint,i:bigint,w:bigint>"


def java_source() -> str:
    """A Java UDF (users, items, text before a user, least word) of the rows (u, i, w), HIT, whose first_words() w is the least word or more.

    Two steps of MD5 are one loop over the chunk's items, short enough that the JVM makes vector instructions of it; what of the message is the same for all items is added to the step's constant.
    """
    steps, calls = [], []
    for turn in range(4):
        for half in range(2):
            s, t = TURNS[16 * turn + 2 * half], TURNS[16 * turn + 2 * half + 1]
            for kind in range(4):  # which of the two words differ between items
                name, m, n = f"s{turn}{half}{kind}", "+m[j]" if kind & 1 else "", "+n[j]" if kind & 2 else ""
                first = f"int x=a[j]+({MIXES[turn]})+k{m}; int y=b[j]+((x<<{s})|(x>>>{32 - s}));"
                second = f"int z=d[j]+({NEXT[turn]})+l{n}; a[j]=y; d[j]=y+((z<<{t})|(z>>>{32 - t}));"
                steps.append(f"  static void {name}(int[] a,int[] b,int[] c,int[] d,int[] m,int[] n,int k,int l,int size){{ for(int j=0;j<size;j++){{ {first} {second} }} }}")
                calls.append(f"      case {8 * turn + 4 * half + kind}: {name}(a,b,c,d,m,n,k,l,size); break;")
    sines, places = ",".join(str(x) for x in SINES.astype(np.int32).tolist()), ",".join(str(p) for p in PLACES)
    start = [np.uint32(x).astype(np.int32).item() for x in START]
    return f"""
import java.util.ArrayList;
import java.util.Arrays;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.api.java.UDF4;

public class FirstWords implements UDF4 {{
  static final int CHUNK = 1024;
  static final int[] SINES = {{{sines}}};
  static final int[] PLACES = {{{places}}};

{chr(10).join(steps)}

  static void two(int t, int kind, int[] a, int[] b, int[] c, int[] d, int[] m, int[] n, int k, int l, int size) {{
    switch (8 * (t / 16) + 4 * (t % 4 / 2) + kind) {{
{chr(10).join(calls)}
    }}
  }}

  static void last(int[] a, int[] b, int[] c, int[] d, int[] m, int k, int size) {{
    if (m == null) for (int j = 0; j < size; j++) {{ int x = a[j] + ({MIXES[3]}) + k; a[j] = b[j] + ((x << {TURNS[60]}) | (x >>> {32 - TURNS[60]})); }}
    else for (int j = 0; j < size; j++) {{ int x = a[j] + ({MIXES[3]}) + k + m[j]; a[j] = b[j] + ((x << {TURNS[60]}) | (x >>> {32 - TURNS[60]})); }}
  }}

  static void put(int[] words, int at, byte[] text) {{
    for (int p = 0; p < text.length; p++) words[(at + p) / 4] |= (text[p] & 255) << (8 * ((at + p) % 4));
  }}

  static byte[] bytes(String text) {{
    byte[] out = new byte[text.length()];
    for (int p = 0; p < out.length; p++) out[p] = (byte) text.charAt(p);
    return out;
  }}

  static long[] numbers(Object column) {{
    scala.collection.Seq seq = (scala.collection.Seq) column;
    long[] out = new long[seq.size()];
    scala.collection.Iterator all = seq.iterator();
    for (int p = 0; p < out.length; p++) out[p] = ((Long) all.next()).longValue();
    return out;
  }}

  public Object call(Object users, Object items, Object before, Object least) throws Exception {{
    long[] us = numbers(users), is = numbers(items);
    int bar = (int) ((Long) least).longValue() ^ Integer.MIN_VALUE;
    ArrayList found = new ArrayList();
    long[][] ids = new long[21][];
    int[] counts = new int[21];
    for (int p = 0; p < is.length; p++) counts[Long.toString(is[p]).length()]++;
    for (int q = 1; q < 21; q++) ids[q] = new long[counts[q]];
    Arrays.fill(counts, 0);
    for (int p = 0; p < is.length; p++) {{ int q = Long.toString(is[p]).length(); ids[q][counts[q]++] = is[p]; }}
    byte[][] heads = new byte[us.length][];
    for (int p = 0; p < us.length; p++) heads[p] = bytes((String) before + Long.toString(us[p]) + ":");
    int[] a = new int[CHUNK], b = new int[CHUNK], c = new int[CHUNK], d = new int[CHUNK];
    for (int q = 1; q < 21; q++) for (int from = 0; from < counts[q]; from += CHUNK) {{
      int size = Math.min(CHUNK, counts[q] - from);
      for (int shift = 0; shift < 4; shift++) {{
        int[][] tails = null;
        for (int p = 0; p < us.length; p++) {{
          byte[] head = heads[p];
          if (head.length % 4 != shift) continue;
          if (head.length + q > 55) throw new IllegalArgumentException("a text of more than 55 bytes");
          if (tails == null) tails = tails(ids[q], from, size, shift, q);
          hashes(head, tails, q, size, a, b, c, d);
          for (int j = 0; j < size; j++) {{
            int w = Integer.reverseBytes(a[j] + ({start[0]}));
            if ((w ^ Integer.MIN_VALUE) >= bar) found.add(RowFactory.create(new Object[] {{ Long.valueOf(us[p]), Long.valueOf(ids[q][from + j]), Long.valueOf(w & 4294967295L) }}));
          }}
        }}
      }}
    }}
    return found;
  }}

  static int[][] tails(long[] ids, int from, int size, int shift, int q) {{
    int[][] out = new int[(shift + q) / 4 + 1][size];
    for (int j = 0; j < size; j++) {{
      String text = Long.toString(ids[from + j]);
      for (int p = 0; p < q; p++) out[(shift + p) / 4][j] |= text.charAt(p) << (8 * ((shift + p) % 4));
      out[(shift + q) / 4][j] |= 128 << (8 * ((shift + q) % 4));
    }}
    return out;
  }}

  /** The first word of the digest, less its start, is left in a: the last three steps don't change it. */
  static void hashes(byte[] head, int[][] tails, int q, int size, int[] a, int[] b, int[] c, int[] d) {{
    int[] same = new int[16];
    int[][] own = new int[16][];
    put(same, 0, head);
    same[14] = 8 * (head.length + q);
    for (int w = 0; w < tails.length; w++) own[head.length / 4 + w] = tails[w];
    int[] A = a, B = b, C = c, D = d;
    Arrays.fill(A, 0, size, {start[0]}); Arrays.fill(B, 0, size, {start[1]}); Arrays.fill(C, 0, size, {start[2]}); Arrays.fill(D, 0, size, {start[3]});
    for (int t = 0; t < 60; t += 2) {{
      int[] m = own[PLACES[t]], n = own[PLACES[t + 1]];
      two(t, (m == null ? 0 : 1) + (n == null ? 0 : 2), A, B, C, D, m, n, SINES[t] + same[PLACES[t]], SINES[t + 1] + same[PLACES[t + 1]], size);
      int[] x = A, y = B;
      A = C; B = D; C = x; D = y;
    }}
    last(A, B, C, D, own[PLACES[60]], SINES[60] + same[PLACES[60]], size);
  }}
}}
"""
