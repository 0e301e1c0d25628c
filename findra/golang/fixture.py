"""Go files in which every check has something to find: ``//@ code ...`` at a line's end names the findings that start on it.

Marks are cut off before the files are used, so expected findings come from the marks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "shapes/naming.go": """
package shapes //@ package-comments

import (
	"errors"
	fmt "fmt" //@ redundant-import-alias
	BadAlias "os" //@ import-alias-naming
	. "strings" //@ dot-imports
	_ "embed" //@ blank-imports
	// driver
	_ "image/png"
	"errors" //@ duplicated-imports
)

var ErrGone, oops = errors.New("gone"), 3 //@ no-package-var no-package-var error-naming exported-declaration-comment

const late = 1 //@ top-level-declaration-order

type Ω1 struct{} //@ banned-characters exported-declaration-comment

func _hidden(snake_case int) {} //@ unexported-naming var-naming unused-parameter

func parse(len int) int { return len } //@ redefines-builtin-id

func Parse(x int) int { return x } //@ confusing-naming exported-declaration-comment

func shadow() int {
	errors := 1 //@ import-shadowing
	return errors
}

func init() { //@ no-init
	fmt.Println(late, oops)
}

func TestSome_thing() {} //@ exported-declaration-comment
""",
    "shapes/functions.go": """
// Package shapes has functions.
package shapes

import (
	"context"
	"sync"
	"time"
)

type point struct{ x, y int }

func wide(a, b, c, d, e, f, g, h, i int) int { return a + b + c + d + e + f + g + h + i } //@ max-parameters

func many() (a int, b int, c int, d int) { //@ function-result-limit
	a = 1
	return //@ no-naked-return
}

func pair() (int, int) { return 1, 2 } //@ confusing-results

func late(n int, ctx context.Context) { _, _ = n, ctx } //@ context-as-argument

func first() (error, int) { return nil, 1 } //@ error-last-result

func wait(wg sync.WaitGroup) { wg.Wait() } //@ waitgroup-by-value copy-lock-value

func Make() point { return point{} } //@ unexported-return exported-declaration-comment

func GetNothing() { println() } //@ get-function-return-value exported-declaration-comment use-fmt-print

func flagged(on bool) int { //@ flag-parameter
	if on {
		return 1
	}
	return 0
}

func change(n int) int {
	n = n + 2 //@ modifies-parameter
	n++ //@ modifies-parameter
	m := n
	m = m + 1 //@ increment-decrement
	return m
}

func (p point) Move() { //@ exported-declaration-comment
	p.x = 3 //@ modifies-value-receiver
}

func (q point) Other() int { return q.y } //@ receiver-naming exported-declaration-comment

func (p point) Idle() int { return 1 } //@ unused-receiver exported-declaration-comment

type codec struct{} //@ top-level-declaration-order

func (this codec) MarshalText() int { return len(this.name()) } //@ receiver-naming exported-declaration-comment

func (this *codec) UnmarshalText() int { return len(this.name()) } //@ receiver-naming marshal-receiver exported-declaration-comment

func (this codec) name() string { return "" } //@ receiver-naming unused-receiver

func ends() {
	many()
	return //@ redundant-final-return
}

func pause(timeoutMs time.Duration) time.Duration { return timeoutMs } //@ time-naming

func branchy(a, b int) int { //@ cyclomatic-complexity cognitive-complexity
	for a < b && b > 0 || a == 3 {
		if a > 1 {
			if b > 2 {
				a++ //@ modifies-parameter
			}
		}
		switch a {
		case 1:
			b-- //@ modifies-parameter
		case 2:
			b += 2 //@ modifies-parameter
		case 3, 4:
			continue
		}
	}
	if a == 7 {
		return 7
	}
	if a == 8 {
		return 8
	}
	return a
}
""",
    "shapes/control.go": """
// Package shapes flows
package shapes //@

import (
	"errors"
	"fmt"
	"os"
	"log"
)

func load() error { return nil }

func flow(n int, m map[string]int, v any) int { //@ cognitive-complexity cyclomatic-complexity
	if n == 1 {
		return 1
	} else { //@ no-else-after-return
		n := 2
		_ = n
	}
	if n == 2 { //@ early-return
		fmt.Println(n)
	} else {
		return 0
	}
	if n == 3 {
		fmt.Println("same")
	} else { //@ identical-branches
		fmt.Println("same")
	}
	if n == 4 {
	} //@
	if n == 5 {
		fmt.Println("a")
	} else if n == 6 {
		fmt.Println("b")
	} else if n == 5 { //@ identical-if-chain-conditions
		fmt.Println("c")
	} else { //@ identical-if-chain-branches
		fmt.Println("a")
	}
	switch n { //@ single-case-switch
	case 1:
		fmt.Println("one")
	}
	switch n {
	default: //@ enforce-switch-style
		fmt.Println("none")
	case 1, 2:
		fmt.Println("low")
	case 3, 1: //@ identical-switch-conditions
		fmt.Println("mid")
		break //@ redundant-switch-break
	case 9: //@ identical-switch-branches
		fmt.Println("low")
	}
	for i := range m {
		defer fmt.Println(i) //@ no-defer-in-loop
	}
	if x, ok := m["a"]; ok { //@ add-constant
		fmt.Println(m["a"], x) //@ inefficient-map-lookup
	}
	s := v.(string) //@ unchecked-type-assertion
	t, ok := v.(int)
	fmt.Println(s, t, ok)
	return n
	fmt.Println("never") //@ unreachable-code
}

func positive(n int) bool {
	if n > 0 { //@ unnecessary-if
		return true
	} else { //@ no-else-after-return
		return false
	}
}

func save() error {
	if err := load(); err != nil { //@ redundant-error-return-check
		return err
	}
	return nil
}

func leave() {
	defer recover() //@ deferred-recover-call
	defer func() int { return 1 }() //@ discarded-deferred-result
	os.Exit(2) //@ deep-exit
	log.Fatalf("no %d", 3) //@ deep-exit unreachable-code
}

func spin(c chan int) {
	for { //@ spinning-select-default
		select {
		case <-c:
			fmt.Println("got")
		default:
		}
	}
}

func deep(a bool) { //@ cognitive-complexity unused-parameter
	for {
		for {
			for {
				for {
					for {
						if errors.Is(nil, nil) { //@ max-control-nesting
							fmt.Println("deep")
						}
					}
				}
			}
		}
	}
}
""",
    "shapes/expressions.go": """
// Package shapes is about expressions.
package shapes

import (
	"errors"
	"fmt"
	"runtime"
	"sort"
	"sync/atomic"
	"time"
)

type tagged struct {
	A int `json:"a" json:"b"` //@ invalid-struct-tag
	B int `json:"b,omitempty"`
	C int `json` //@ invalid-struct-tag
	D struct{ e int } //@ nested-structs
}

func calls(n int, a []int, s string) { //@ unused-parameter
	runtime.GC() //@ call-to-gc
	println(n) //@ use-fmt-print
	sort.Slice(a, nil) //@ use-slices-sort
	_ = fmt.Errorf("plain") //@ use-errors-new
	_ = fmt.Errorf("bad %d", n)
	_ = errors.New(fmt.Sprintf("n %d", n)) //@ prefer-fmt-errorf
	_ = fmt.Sprintf("nothing") //@ unnecessary-format
	_ = string(65) //@ string-of-int
	_ = string(int32(n)) //@ string-of-int
	_ = errors.New("Bad thing") //@ error-strings
	_ = errors.New("bad thing.") //@ error-strings
	_ = errors.New("URL is bad")
	_ = time.Date(2020, 13, 1, 24, 0, 0, 0, nil) //@ time-date time-date
}

func values(n int, p *int, b bool) bool { //@ flag-parameter
	var count int64
	count = atomic.AddInt64(&count, 1) //@ redundant-atomic-result-assignment
	_ = n % 1 //@ modulo-one
	_ = 2 / 3 //@ zero-integer-division
	_ = 3 / 2
	_ = *&n //@ ineffective-pointer-copy
	_ = &*p //@ ineffective-pointer-copy
	_ = false && b //@ constant-logical-expr
	_, _, _ = n, p, b //@ excessive-blank-identifiers
	var zero int = 0 //@ var-declaration
	var free interface{} //@ use-any
	fmt.Println(zero, free, count, "http://example.test/a") //@ insecure-url-scheme
	if b == true { //@ boolean-literal-comparison
		return !!b //@ double-negation
	}
	return false
}

func ranges(s string, a []int) []*int {
	out := []*int{}
	for _, r := range []rune(s) { //@ simplify-range
		fmt.Println(r)
	}
	for i, _ := range a { //@ simplify-range
		fmt.Println(i)
	}
	for _, v := range a {
		out = append(out, &v) //@ range-value-address
	}
	return out
}

func literals() {
	fmt.Println("thrice", "twice", "twice")
	fmt.Println("thrice")
	fmt.Println("thrice") //@ add-constant
}
""",
    "other/files.go": """
//go:build linux
// +build linux //@ redundant-build-tag

// Package wrong has a name
package wrong //@ package-directory-mismatch

// go:generate nothing //@ spaced-compiler-directive

// TODO: later //@ task-comment

// Fixed things, not a FIXMEs.

// Good does good.
func Good() {}

// Bad, says the comment
func Fine() {} //@ exported-declaration-comment

type ( //@ top-level-declaration-order
	A1 struct{}
	A2 struct{}
	A3 struct{}
	A4 struct{}
	A5 struct{}
	A6 struct{} //@ max-public-structs
)

func generic[T any, K comparable](a map[K]T, f func(T) bool) []T {
	var out []T
	for _, v := range a {
		if f(v) {
			out = append(out, v)
		}
	}
	return out
}
""",
    "semantic/calls.go": """
// Package semantic has suspicious calls.
package semantic

import (
	"crypto/md5"
	"net/http"
	"os"
	"os/exec"
	"os/signal"
	"strconv"
	"strings"
	"sync"
	"testing"
	"time"
)

const (
	red color = 1 //@ partially-typed-constant-group
	green = 2
	blue = 3
)

type color int

func all(mu *sync.Mutex, rw *sync.RWMutex, c chan os.Signal, f *os.File, s []int) {
	_ = md5.New() //@ weak-cryptography
	time.Sleep(5) //@ suspicious-sleep
	time.Sleep(5 * time.Second)
	_ = exec.Command("ls -l") //@ invalid-exec-command
	_ = exec.Command("ls", "-l")
	_ = strings.Replace("a", "b", "c", 0) //@ zero-replacement-limit
	_ = rand.Intn(1) //@ random-bound-one
	signal.Notify(c, os.Interrupt, os.Kill) //@ untrappable-signal
	_ = strings.Trim("x", "aba") //@ duplicate-trim-cutset
	_ = os.Mkdir("d", 755) //@ decimal-file-mode
	_ = os.Mkdir("d", 0755)
	f.Seek(io.SeekStart, 0) //@ swapped-seek-arguments
	s = append(s) //@ single-argument-append modifies-parameter
	_, _ = http.NewRequest("GET", "https://example.test", nil) //@ standard-http-method-constant
	_ = os.RemoveAll(os.TempDir()) //@ dangerous-directory-removal
	_, _ = strconv.ParseInt("1", 1, 64) //@ invalid-strconv-argument
	_, _ = strconv.ParseFloat("1", 60) //@ invalid-strconv-argument
	mu.Lock() //@ deferred-lock-after-lock
	defer mu.Lock()
	rw.RLock() //@ empty-critical-section
	rw.RUnlock()
	for { //@ spinning-empty-loop
	}
}

func lengths(s []int) bool {
	_ = -0.0 //@ constant-negative-zero
	return len(s) < 0 || 0 > cap(s) //@ negative-length-capacity-comparison negative-length-capacity-comparison
}

func BenchmarkIt(b *testing.B) { //@ exported-declaration-comment
	b.N = 10 //@ benchmark-iteration-mutation modifies-parameter
}

func TestMain(m *testing.M) { //@ test-main-missing-exit exported-declaration-comment
	m.Run()
}
""",
    "semantic/constants.go": """
// Package semantic has calls with suspicious constants.
package semantic

import (
	"bytes"
	"context"
	"encoding/hex"
	"errors"
	"fmt"
	"io"
	"log/slog"
	"math"
	"net"
	"net/http"
	"net/url"
	re "regexp"
	"sort"
	"strings"
	"time"
)

const brokenPattern = "(a"

const listenAll = ":" + "99999"

type holder struct {
	ctx context.Context //@ context-stored-in-struct
	next func(context.Context)
}

type elevenWays interface { //@ interface-method-limit
	one(); two(); three(); four(); five(); six(); seven(); eight(); nine(); ten(); eleven()
}

type tenWays interface {
	one(); two(); three(); four(); five(); six(); seven(); eight(); nine(); ten()
}

func operators(a, b *int, n, m int, x, y string, f float64) {
	_ = &n == nil //@ address-nil-comparison
	_ = (nil) != &m //@ address-nil-comparison
	_ = a == nil
	_ = strings.ToLower(x) == strings.ToLower(y) //@ case-insensitive-string-comparison
	_ = strings.ToLower(x) == strings.ToUpper(y)
	_ = n-m == n-m //@ identical-binary-operands
	_ = n + n
	_ = n - m
	_ = n & 0 //@ ineffective-bitwise-zero
	_ = n | (0x0) //@ ineffective-bitwise-zero
	_ = n | 1
	_ = f == math.NaN() //@ nan-comparison
	_ = math.IsNaN(f)
	_ = time.Second * time.Minute //@ duration-multiplied-by-duration
	_ = 3 * time.Minute
	_ = uint8(n) << 8 //@ oversized-fixed-width-shift
	_ = uint16(n) << 8
	n = n //@ self-assignment modifies-parameter
	a, b = b, a //@ modifies-parameter modifies-parameter
}

func constants(w io.Writer, r *http.Request, raw []byte, ctx context.Context, key any, err error, format string, names []string) { //@ context-as-argument
	_, _ = io.WriteString(w, string(raw)) //@ byte-string-write
	_, _ = io.WriteString(w, format)
	_ = context.WithValue(ctx, "user", 1) //@ context-key-type
	_ = context.WithValue(ctx, struct{}{}, 1) //@ context-key-type nested-structs
	_ = context.WithValue(ctx, key, 1)
	_ = context.WithValue(nil, key, 1) //@ nil-context
	fmt.Printf(format) //@ dynamic-printf
	fmt.Printf(format, 1)
	fmt.Printf("plain %d", 1)
	_ = fmt.Errorf(err.Error()) //@ dynamic-printf
	_ = strings.NewReplacer("a", "b", "c") //@ odd-paired-arguments
	_ = strings.NewReplacer("d", "e")
	pattern := re.MustCompile("[a-z]+(?P<rest>.*)$")
	_ = pattern.FindAllString(format, 0) //@ regexp-find-all-zero
	_ = pattern.FindAllString(format, -1)
	for _, name := range names {
		_, _ = re.MatchString("^ok$", name) //@ regexp-match-in-loop
		_, _ = re.MatchString(name, format)
	}
	_ = errors.Is(io.EOF, err) //@ swapped-errors-is-arguments
	_ = errors.Is(err, io.EOF)
	hex.Encode(raw, raw) //@ overlapping-encode-buffers
	hex.Encode(raw[4:], raw)
	r.URL.Query().Set("k", "v") //@ url-query-copy-mutation
	values := r.URL.Query()
	values.Set("k", "v")
	strings.TrimSpace(format) //@ discarded-pure-result
	_ = strings.TrimSpace(format)
	_ = fmt.Sprintf("http://%s:%d/x", format, 1) //@ unsafe-formatted-url-host-port insecure-url-scheme
	_ = fmt.Sprintf("%s/%d", format, 1)
	_, _ = net.Dial("tcp", fmt.Sprintf("%s:%d", format, 2)) //@ unsafe-formatted-url-host-port
	names = sort.StringSlice(names) //@ sort-conversion-without-sort modifies-parameter
	sort.Sort(sort.StringSlice(names))
	_ = r.Header["content-type"] //@ non-canonical-header
	_ = r.Header["Content-Length"]
	r.Header["x-odd"] = nil //@ modifies-parameter
	slog.Info("said", "count") //@ slog-argument-shape
	slog.Info("said", "count", 1)
	slog.Info("said", slog.Int("n", 1), "count", 2) //@ slog-argument-shape add-constant add-constant
	slog.Info("said", slog.Int("n", 1))
	_ = bytes.Equal(raw, raw)
}

func languages(name string) {
	_ = re.MustCompile(brokenPattern) //@ invalid-regexp
	_ = re.MustCompile(`a(?=b)`) //@ invalid-regexp
	_ = re.MustCompile("a**") //@ invalid-regexp
	_ = re.MustCompile(`\\pL+[[:alpha:]\\d-]{2,5}?\\z`)
	_ = re.MustCompile(name)
	_, _ = url.Parse("%zz") //@ invalid-url
	_, _ = url.Parse("https://example.test:8x/") //@ invalid-url
	_, _ = url.Parse("https://user@example.test:80/a%20b?c#d")
	_ = http.ListenAndServe("localhost", nil) //@ invalid-listen-address
	_ = http.ListenAndServe(listenAll, nil) //@ invalid-listen-address
	_ = http.ListenAndServe("[::1]:http", nil)
	_ = strings.Trim(name, "\\xff") //@ invalid-utf8
	_ = strings.Trim(name, "\\u00ff")
}
""",
    "semantic/local.go": """
// Package semantic follows names.
package semantic

import (
	"bytes"
	"context"
	"database/sql"
	"encoding/json"
	"errors"
	"fmt"
	"math"
	"net"
	"net/http"
	"os"
	"os/signal"
	"runtime"
	"sync"
	"testing"
	"time"
)

type guarded struct {
	mu sync.Mutex
	n int
}

type lost struct{} //@ error-type-naming

func (l *lost) Error() string { return "lost" } //@ exported-declaration-comment unused-receiver

type sparseError struct{ code int } //@ top-level-declaration-order

func (s *sparseError) Error() string { return "sparse" } //@ exported-declaration-comment unused-receiver

type hidden struct{ value int }

type sink struct{ n int }

func (s *sink) Write(p []byte) (int, error) { //@ exported-declaration-comment
	p[0] = 1 //@ writer-buffer-mutation modifies-parameter
	s.n += len(p)
	return len(p), nil
}

func fail() error { return errors.New("failed") }

func opener() func() { return func() {} }

func copies(g guarded, p *guarded) int { return g.n + p.n } //@ copy-lock-value

func resources(client *http.Client, db *sql.DB, r *http.Request) error {
	fail() //@ discarded-error-result
	f, err := os.Open("a")
	defer f.Close() //@ defer-close-before-error-check
	if err != nil {
		return nil //@ nil-error-return
	}
	defer opener() //@ deferred-return-function-not-called
	defer opener()()
	resp, err := client.Do(r) //@ unclosed-http-response-body
	if err != nil {
		return err
	}
	fmt.Println(resp.Status)
	good, err := client.Do(r)
	defer good.Body.Close()
	rows, err := db.Query("select 1") //@ unclosed-sql-resource
	for rows.Next() { //@ unchecked-rows-error
		fmt.Println("row")
	}
	return err
}

func find(id int) (*hidden, error) {
	if id == 0 {
		return nil, nil //@ nil-value-with-nil-error
	}
	return &hidden{id}, nil
}

func concurrency(t *testing.T, jobs []int) {
	var wg sync.WaitGroup
	go func() { //@ testing-fatal-in-goroutine
		wg.Add(1) //@ waitgroup-add-inside-goroutine
		t.Fatal("no")
	}()
	wg.Add(1)
	wg.Go(func() {
		wg.Done() //@ waitgroup-go-forbidden-call
	})
	c := make(chan os.Signal)
	signal.Notify(c, os.Interrupt) //@ unbuffered-signal-channel
	d := make(chan os.Signal, 1)
	signal.Notify(d, os.Interrupt)
	h := &hidden{}
	runtime.SetFinalizer(h, func(x *hidden) { fmt.Println(h.value, x) }) //@ finalizer-captures-object
	runtime.SetFinalizer(h, func(x *hidden) { fmt.Println(x.value) })
	for range jobs {
		ctx, cancel := context.WithCancel(context.Background()) //@ context-cancel-in-loop
		defer cancel() //@ no-defer-in-loop
		fmt.Println(ctx)
	}
	for range jobs {
		_, stop := context.WithCancel(context.Background())
		stop()
	}
}

func typed(when, then time.Time, n uint, count int, name string, ip, other net.IP, raw []byte) bool {
	_ = when == then //@ time-value-equality
	_ = when.Equal(then)
	_ = n < 0 //@ impossible-integer-comparison
	_ = count < 0
	_ = bytes.Equal(ip, other) //@ ip-byte-comparison
	_ = string(name) //@ redundant-conversion
	_ = string(raw)
	_ = fmt.Sprintf("%s", name) //@ inefficient-sprintf
	_ = fmt.Sprintf("%s!", name)
	_ = math.Floor(float64(count)) //@ pointless-integer-math
	_ = math.Floor(1.5)
	var pool sync.Pool
	pool.Put(raw) //@ non-pointer-sync-pool-value
	pool.Put(&raw)
	var into hidden
	_ = json.Unmarshal(raw, into) //@ non-pointer-unmarshal
	_ = json.Unmarshal(raw, &into)
	_, _ = json.Marshal(into) //@ unexported-serialization-fields
	_, _ = json.Marshal(count)
	return n == 1
}

func flows(limit int, given string, list []int) []int { //@ argument-overwritten-before-use cognitive-complexity
	given = "fixed" //@ modifies-parameter
	var m map[string]int
	m["a"] = 1 //@ nil-map-assignment
	k := map[string]int{}
	k["a"] = 1 //@ add-constant
	sized := make([]int, 4) //@ append-to-sized-slice
	sized = append(sized, 1)
	roomy := make([]int, 0, 4)
	roomy = append(roomy, 1)
	_ = append(roomy, 2) //@ unused-append-result
	fresh := &hidden{}
	if fresh != nil { //@ never-nil-comparison
		fmt.Println(given, sized)
	}
	for i := 0; i < limit; limit++ { //@ modifies-parameter
		fmt.Println("turn")
	}
	j := 0
	for i := 0; j < 3; i++ { //@ unchanged-loop-condition
		fmt.Println(i)
	}
	for _, v := range list {
		if v > 3 {
			fmt.Println(v)
		}
		break //@ single-iteration-loop
	}
	for _, v := range list {
		if v > 4 {
			continue
		}
		return roomy
	}
	return roomy
}

func forever(n int) int {
	fmt.Println(n)
	return forever(n) //@ infinite-recursion
}

func bounded(n int) int {
	if n == 0 {
		return 0
	}
	return bounded(n - 1)
}
""",
    "Odd name/bad file.go": """
// Package Odd_Name is odd.
package Odd_Name //@ package-naming
""",
}
#: Findings of whole files and those that marks cannot hold: file, line, code.
MORE = [
    ("shapes/naming.go", 1, "format"), ("shapes/control.go", 1, "format"),
    ("Odd name/bad file.go", 1, "filename-format"), ("Odd name/bad file.go", 2, "package-directory-mismatch"), ("shapes/control.go", 1, "doc-comment-period"), ("other/files.go", 4, "doc-comment-period"),
    ("other/files.go", 16, "doc-comment-period"), ("shapes/control.go", 30, "empty-conditional-block"), ("shapes/hidden.go", 3, "bidirectional-control-character"),
]
HIDDEN = b"// Package shapes hides.\npackage shapes\n// a\xe2\x80\xaeb.\n"
MARK = " //@"


def sources() -> dict[str, str]:
    """Files without marks."""
    out = {}
    for path, text in FILES.items():
        out[path] = "".join(line.split(MARK)[0] + "\n" for line in text.strip("\n").split("\n"))
    return out | {"shapes/hidden.go": HIDDEN.decode()}


def expected() -> list[tuple[str, int, str]]:
    """``file, line, code`` of every finding."""
    out = list(MORE)
    for path, text in FILES.items():
        for n, line in enumerate(text.strip("\n").split("\n"), 1):
            if MARK in line:
                out += [(path, n, code) for code in line.split(MARK)[1].split()]
    return sorted(out)


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, t.encode()) for p, t in sources().items()], "path string, content binary")
